"""Part of the citation checker."""
