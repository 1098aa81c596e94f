"""Reference tables: reporters, their variant spellings, courts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import squash

# Editions (abbreviation, name, series, first year, last year, jurisdiction) of the
# reporters cited most. published_reporters() reads all of them from a published list.
EDITIONS = [
    ("U.S.", "United States Supreme Court Reports", "U.S.", 1875, None, "federal"),
    ("S. Ct.", "West's Supreme Court Reporter", "S. Ct.", 1882, None, "federal"),
    ("L. Ed.", "Lawyer's Edition", "L. Ed.", 1790, 1956, "federal"),
    ("L. Ed. 2d", "Lawyer's Edition", "L. Ed.", 1956, None, "federal"),
    ("F.", "Federal Reporter", "F.", 1880, 1924, "federal"),
    ("F.2d", "Federal Reporter", "F.", 1924, 1993, "federal"),
    ("F.3d", "Federal Reporter", "F.", 1993, None, "federal"),
    ("F.4th", "Federal Reporter", "F.", 2021, None, "federal"),
    ("F. Supp.", "Federal Supplement", "F. Supp.", 1932, 1988, "federal"),
    ("F. Supp. 2d", "Federal Supplement", "F. Supp.", 1988, 2014, "federal"),
    ("F. Supp. 3d", "Federal Supplement", "F. Supp.", 2014, None, "federal"),
    ("F. App'x", "Federal Appendix", "F. App'x", 2001, None, "federal"),
    ("F.R.D.", "Federal Rules Decisions", "F.R.D.", 2001, None, "specialty"),
    ("B.R.", "Bankruptcy Reporter", "B.R.", 1979, None, "specialty"),
    ("Fed. Cl.", "United States Claims Court Reporter", "Fed. Cl.", 1992, None, "specialty"),
    ("Cl. Ct.", "United States Claims Court Reporter", "Cl. Ct.", 1983, 1992, "specialty"),
    ("Ct. Cl.", "Court of Claims Reports (United States)", "Ct. Cl.", 1863, None, "specialty"),
    ("F. Cas.", "Federal Cases", "F. Cas.", 1789, 1880, "federal"),
    ("M.J.", "Military Justice Reporter", "M.J.", 1975, None, "specialty"),
    ("T.C.", "Reports of the United States Tax Court", "T.C.", 1942, None, "specialty"),
    ("Vet. App.", "Veterans Appeals Reporter", "Vet. App.", 1990, None, "specialty"),
    ("Ct. Int'l Trade", "Court of International Trade Reports", "Ct. Int'l Trade", 1980, None, "specialty"),
    ("Dall.", "Pennsylvania State Reports, Dallas", "Dall.", 1754, 1880, "federal"),
    ("Cranch", "Cranch's Supreme Court Reports", "Cranch", 1801, 1841, "federal"),
    ("Wheat.", "Wheaton's Supreme Court Reports", "Wheat.", 1816, 1827, "federal"),
    ("Pet.", "Peters' Supreme Court Reports", "Pet.", 1828, 1842, "federal"),
    ("How.", "Howard's Supreme Court Reports", "How.", 1843, 1860, "federal"),
    ("Black", "Black's Supreme Court Reports", "Black", 1861, 1862, "federal"),
    ("Wall.", "Wallace's Supreme Court Reports", "Wall.", 1863, 1874, "federal"),
    ("A.", "Atlantic Reporter", "A.", 1885, 1938, "regional"),
    ("A.2d", "Atlantic Reporter", "A.", 1938, 2010, "regional"),
    ("A.3d", "Atlantic Reporter", "A.", 2010, None, "regional"),
    ("N.E.", "North Eastern Reporter", "N.E.", 1884, 1936, "regional"),
    ("N.E.2d", "North Eastern Reporter", "N.E.", 1936, 2013, "regional"),
    ("N.E.3d", "North Eastern Reporter", "N.E.", 2013, None, "regional"),
    ("N.W.", "North Western Reporter", "N.W.", 1880, 1942, "regional"),
    ("N.W.2d", "North Western Reporter", "N.W.", 1942, 2023, "regional"),
    ("N.W.3d", "North Western Reporter", "N.W.", 2024, None, "regional"),
    ("P.", "Pacific Reporter", "P.", 1883, 1931, "regional"),
    ("P.2d", "Pacific Reporter", "P.", 1931, 2000, "regional"),
    ("P.3d", "Pacific Reporter", "P.", 2000, None, "regional"),
    ("S.E.", "South Eastern Reporter", "S.E.", 1887, 1939, "regional"),
    ("S.E.2d", "South Eastern Reporter", "S.E.", 1939, None, "regional"),
    ("S.W.", "South Western Reporter", "S.W.", 1886, 1928, "regional"),
    ("S.W.2d", "South Western Reporter", "S.W.", 1928, 1999, "regional"),
    ("S.W.3d", "South Western Reporter", "S.W.", 1999, None, "regional"),
    ("So.", "Southern Reporter", "So.", 1886, 1941, "regional"),
    ("So. 2d", "Southern Reporter", "So.", 1941, 2008, "regional"),
    ("So. 3d", "Southern Reporter", "So.", 2008, None, "regional"),
    ("Ala.", "Alabama Reports", "Ala.", 1840, 1976, "state"),
    ("Ala. App.", "Alabama Appellate Courts Reports", "Ala. App.", 1910, 1976, "state"),
    ("Alaska", "Alaska Reports", "Alaska", 1884, 1959, "state"),
    ("Ariz.", "Arizona Reporter", "Ariz.", 1866, None, "state"),
    ("Ariz. App.", "Arizona Appeals Reports", "Ariz. App.", 1965, 1976, "state"),
    ("Ark.", "Arkansas Reports", "Ark.", 1837, None, "state"),
    ("Ark. App.", "Arkansas Appellate Reports", "Ark. App.", 1981, None, "state"),
    ("Cal.", "California Reports", "Cal.", 1850, 1934, "state"),
    ("Cal. 2d", "California Reports", "Cal.", 1934, 1969, "state"),
    ("Cal. 3d", "California Reports", "Cal.", 1969, 1991, "state"),
    ("Cal. 4th", "California Reports", "Cal.", 1991, None, "state"),
    ("Cal. 5th", "California Reports", "Cal.", 1991, None, "state"),
    ("Cal. App.", "California Appellate Reports", "Cal. App.", 1905, 1934, "state"),
    ("Cal. App. 2d", "California Appellate Reports", "Cal. App.", 1934, 1969, "state"),
    ("Cal. App. 3d", "California Appellate Reports", "Cal. App.", 1969, 1991, "state"),
    ("Cal. App. 4th", "California Appellate Reports", "Cal. App.", 1991, None, "state"),
    ("Cal. App. 5th", "California Appellate Reports", "Cal. App.", 1991, None, "state"),
    ("Cal. Rptr.", "West's California Reporter", "Cal. Rptr.", 1959, 1991, "state"),
    ("Cal. Rptr. 2d", "West's California Reporter", "Cal. Rptr.", 1992, 2003, "state"),
    ("Cal. Rptr. 3d", "West's California Reporter", "Cal. Rptr.", 2003, None, "state"),
    ("Colo.", "Colorado Reports", "Colo.", 1864, 1980, "state"),
    ("Colo. App.", "Colorado Court of Appeals Reports", "Colo. App.", 1891, 1980, "state"),
    ("Conn.", "Connecticut Reports", "Conn.", 1814, None, "state"),
    ("Conn. App.", "Connecticut Appellate Reports", "Conn. App.", 1983, None, "state"),
    ("Conn. Supp.", "Connecticut Supplement", "Conn. Supp.", 1935, None, "state"),
    ("D.C.", "District of Columbia Reports", "D.C.", 1801, 1893, "state"),
    ("App. D.C.", "Appeal Cases, District of Columbia", "App. D.C.", 1893, 1941, "state"),
    ("Del.", "Delaware Reports", "Del.", 1920, 1966, "state"),
    ("Del. Ch.", "Delaware Chancery Reports", "Del. Ch.", 1814, 1968, "state"),
    ("Fla.", "Florida Reports", "Fla.", 1846, 1948, "state"),
    ("Ga.", "Georgia Reports", "Ga.", 1846, None, "state"),
    ("Ga. App.", "Georgia Appeals Reports", "Ga. App.", 1907, None, "state"),
    ("Haw.", "Hawaii Reports", "Haw.", 1847, None, "state"),
    ("Haw. App.", "Hawaii Appellate Reports", "Haw. App.", 1980, 1994, "state"),
    ("Idaho", "Idaho Reports", "Idaho", 1982, None, "state"),
    ("Ill.", "Illinois Reports", "Ill.", 1849, None, "state"),
    ("Ill. 2d", "Illinois Reports", "Ill.", 1849, None, "state"),
    ("Ill. App.", "Illinois Appellate Court Reports", "Ill. App.", 1877, None, "state"),
    ("Ill. App. 2d", "Illinois Appellate Court Reports", "Ill. App.", 1877, None, "state"),
    ("Ill. App. 3d", "Illinois Appellate Court Reports", "Ill. App.", 1877, None, "state"),
    ("Ill. Dec.", "West's Illinois Decisions", "Ill. Dec.", 1976, None, "state"),
    ("Ind.", "Indiana Reports", "Ind.", 1848, 1981, "state"),
    ("Ind. App.", "Indiana Court of Appeals Reports", "Ind. App.", 1890, 1979, "state"),
    ("Iowa", "Iowa Reports", "Iowa", 1855, 1968, "state"),
    ("Kan.", "Kansas Reports", "Kan.", 1862, None, "state"),
    ("Kan. App. 2d", "Kansas Court of Appeals Reports", "Kan. App.", 1977, None, "state"),
    ("Ky.", "Kentucky Reports", "Ky.", 1879, 1951, "state"),
    ("La.", "Louisiana Reports", "La.", 1830, 1972, "state"),
    ("La. Ann.", "Louisiana Annual Reports", "La. Ann.", 1846, 1900, "state"),
    ("Mass.", "Massachusetts Reports", "Mass.", 1867, None, "state"),
    ("Mass. App. Ct.", "Massachusetts Appeals Court Reports", "Mass. App. Ct.", 1972, None, "state"),
    ("Md.", "Maryland Reports", "Md.", 1851, None, "state"),
    ("Md. App.", "Maryland Appellate Reports", "Md. App.", 1967, None, "state"),
    ("Me.", "Maine Reports", "Me.", 1820, 1965, "state"),
    ("Mich.", "Michigan Reports", "Mich.", 1847, None, "state"),
    ("Mich. App.", "Michigan Appeals Reports", "Mich. App.", 1965, None, "state"),
    ("Minn.", "Minnesota Reports", "Minn.", 1851, 1977, "state"),
    ("Miss.", "Mississippi Reports", "Miss.", 1851, 1966, "state"),
    ("Mo.", "Missouri Reports", "Mo.", 1821, 1956, "state"),
    ("Mo. App.", "Missouri Appeals Reports", "Mo. App.", 1876, 1954, "state"),
    ("Mont.", "Montana Reports", "Mont.", 1868, None, "state"),
    ("N.C.", "North Carolina Reports", "N.C.", 1868, None, "state"),
    ("N.C. App.", "North Carolina Court of Appeals Reports", "N.C. App.", 1968, None, "state"),
    ("N.D.", "North Dakota Reports", "N.D.", 1890, 1953, "state"),
    ("N.H.", "New Hampshire Reports", "N.H.", 1816, None, "state"),
    ("N.J.", "New Jersey Reports", "N.J.", 1948, None, "state"),
    ("N.J.L.", "New Jersey Law Reports", "N.J.L.", 1790, 1948, "state"),
    ("N.J. Eq.", "New Jersey Equity Reports", "N.J. Eq.", 1830, 1948, "state"),
    ("N.J. Super.", "New Jersey Superior Court Reports", "N.J. Super.", 1948, None, "state"),
    ("N.M.", "New Mexico Reports", "N.M.", 1852, None, "state"),
    ("N.Y.", "New York Reports", "N.Y.", 1847, 1956, "state"),
    ("N.Y.2d", "New York Reports", "N.Y.", 1956, 2004, "state"),
    ("N.Y.3d", "New York Reports", "N.Y.", 2004, None, "state"),
    ("A.D.", "New York Supreme Court Appellate Division Reports", "A.D.", 1896, 1955, "state"),
    ("A.D.2d", "New York Supreme Court Appellate Division Reports", "A.D.", 1955, 2004, "state"),
    ("A.D.3d", "New York Supreme Court Appellate Division Reports", "A.D.", 2003, None, "state"),
    ("N.Y.S.", "New York Supplement", "N.Y.S.", 1888, 1937, "state"),
    ("N.Y.S.2d", "New York Supplement", "N.Y.S.", 1938, None, "state"),
    ("N.Y.S.3d", "New York Supplement", "N.Y.S.", 1938, None, "state"),
    ("Misc.", "New York Miscellaneous Reports", "Misc.", 1892, 1955, "state"),
    ("Misc. 2d", "New York Miscellaneous Reports", "Misc.", 1955, 2004, "state"),
    ("Misc. 3d", "New York Miscellaneous Reports", "Misc.", 2004, None, "state"),
    ("Neb.", "Nebraska Reports", "Neb.", 1860, None, "state"),
    ("Nev.", "Nevada Reports", "Nev.", 1865, None, "state"),
    ("Ohio St.", "Ohio State Reports", "Ohio St.", 1840, 1964, "state"),
    ("Ohio St. 2d", "Ohio State Reports", "Ohio St.", 1965, 1991, "state"),
    ("Ohio St. 3d", "Ohio State Reports", "Ohio St.", 1991, None, "state"),
    ("Ohio App.", "Ohio Appellate Reports", "Ohio App.", 1913, None, "state"),
    ("Ohio App. 2d", "Ohio Appellate Reports", "Ohio App.", 1913, None, "state"),
    ("Ohio App. 3d", "Ohio Appellate Reports", "Ohio App.", 1913, None, "state"),
    ("Okla.", "Oklahoma Reports", "Okla.", 1890, 1953, "state"),
    ("Okla. Crim.", "Oklahoma Criminal Reports", "Okla. Crim.", 1908, 1953, "state"),
    ("Or.", "Oregon Reports", "Or.", 1853, None, "state"),
    ("Or. App.", "Oregon Reports, Court of Appeals", "Or. App.", 1969, None, "state"),
    ("Pa.", "Pennsylvania State Reports", "Pa.", 1845, None, "state"),
    ("Pa. Super.", "Pennsylvania Superior Court Reports", "Pa. Super.", 1895, None, "state"),
    ("R.I.", "Rhode Island Reports", "R.I.", 1828, 1980, "state"),
    ("S.C.", "South Carolina Reports", "S.C.", 1868, None, "state"),
    ("S.D.", "South Dakota Reports", "S.D.", 1890, 1976, "state"),
    ("Tenn.", "Tennessee Reports", "Tenn.", 1870, 1971, "state"),
    ("Tenn. App.", "Tennessee Appeals Reports", "Tenn. App.", 1925, 1971, "state"),
    ("Tex.", "Texas Reports", "Tex.", 1846, 1962, "state"),
    ("Tex. Civ. App.", "Texas Civil Appeals Reports", "Tex. Civ. App.", 1892, 1911, "state"),
    ("Tex. Crim.", "Texas Criminal Reports", "Tex. Crim.", 1891, 1962, "state"),
    ("Utah", "Utah Reports", "Utah", 1851, 1974, "state"),
    ("Utah 2d", "Utah Reports", "Utah", 1851, 1974, "state"),
    ("Va.", "Virginia Reports", "Va.", 1880, None, "state"),
    ("Va. App.", "Virginia Court of Appeals Reports", "Va. App.", 1985, None, "state"),
    ("Vt.", "Vermont Reports", "Vt.", 1826, None, "state"),
    ("W. Va.", "West Virginia Reports", "W. Va.", 1864, None, "state"),
    ("Wash.", "Virginia Reports, Washington", "Wash.", 1790, None, "state"),
    ("Wash. 2d", "Washington Reports", "Wash.", 1889, 2023, "state"),
    ("Wash. App.", "Washington Appellate Reports", "Wash. App.", 1969, None, "state"),
    ("Wash. App. 2d", "Washington Appellate Reports", "Wash. App.", 1969, None, "state"),
    ("Wis.", "Wisconsin Reports", "Wis.", 1853, None, "state"),
    ("Wis. 2d", "Wisconsin Reports", "Wis.", 1853, None, "state"),
    ("Wyo.", "Wyoming Reports", "Wyo.", 1870, 1959, "state"),
    ("U.S. App. LEXIS", "LexisNexis U.S. Appeals Citation", "U.S. App. LEXIS", 1750, None, "specialty"),
    ("WL", "West Law Citation", "WL", 1750, None, "specialty"),
    ("ND", "North Dakota Neutral Citation", "ND", 1750, None, "state"),
]
# Reporters of the Supreme Court of the United States alone; of unpublished dispositions.
SCOTUS_ONLY = ["U.S.", "S. Ct.", "L. Ed.", "L. Ed. 2d", "Dall.", "Cranch", "Wheat.", "Pet.", "How.", "Black", "Wall."]
NON_PRECEDENTIAL = ["F. App'x", "U.S. App. LEXIS"]
# Other spellings of an abbreviation.
VARIATIONS = {"Fed. Rep.": "F.", "Fed. Rept.": "F.", "Fed. App'x": "F. App'x", "Fed. Appx.": "F. App'x", "F. Supp.2d": "F. Supp. 2d", "Sup. Ct.": "S. Ct.", "U.S. Rep.": "U.S.", "U.S.R.": "U.S.", "Lawyers Ed.": "L. Ed.", "L.Ed.2d.": "L. Ed. 2d", "Atl.": "A.", "Pac.": "P.", "N.E. Rep.": "N.E.", "Cal. Reptr.": "Cal. Rptr.", "Cal. Rprt.": "Cal. Rptr."}
# Courts (id, name, abbreviation, level, federal, first year, other names).
_CIRCUITS = [("1", "First", "1st", 1891), ("2", "Second", "2d", 1891), ("3", "Third", "3d", 1891), ("4", "Fourth", "4th", 1891), ("5", "Fifth", "5th", 1891), ("6", "Sixth", "6th", 1891), ("7", "Seventh", "7th", 1891), ("8", "Eighth", "8th", 1891), ("9", "Ninth", "9th", 1891), ("10", "Tenth", "10th", 1929), ("11", "Eleventh", "11th", 1981)]
_OTHER_FORMS = {"2": ["2nd Cir."], "3": ["3rd Cir."]}
COURTS = [
    ("scotus", "Supreme Court of the United States", "U.S.", "supreme", True, 1789, ["Supreme Court of the United States", "SCOTUS", "U.S. Sup. Ct."]),
    *((f"ca{n}", f"United States Court of Appeals for the {word} Circuit", f"{short} Cir.", "appellate", True, year, [f"{word} Circuit", *_OTHER_FORMS.get(n, []), f"C.A.{n}"]) for n, word, short, year in _CIRCUITS),
    ("cadc", "United States Court of Appeals for the District of Columbia Circuit", "D.C. Cir.", "appellate", True, 1893, ["D.C. Circuit"]),
    ("cafc", "United States Court of Appeals for the Federal Circuit", "Fed. Cir.", "appellate", True, 1982, ["Federal Circuit"]),
    ("dcd", "United States District Court for the District of Columbia", "D.D.C.", "trial", True, 1801, ["District of Columbia"]),
    ("nysd", "United States District Court for the Southern District of New York", "S.D.N.Y.", "trial", True, 1789, ["Southern District of New York", "S.D. New York", "S.D.N.Y"]),
    ("nyed", "United States District Court for the Eastern District of New York", "E.D.N.Y.", "trial", True, 1865, ["Eastern District of New York"]),
    ("nysb", "United States Bankruptcy Court for the Southern District of New York", "Bankr. S.D.N.Y.", "trial", True, 1979, []),
    ("cand", "United States District Court for the Northern District of California", "N.D. Cal.", "trial", True, 1886, ["Northern District of California"]),
    ("cacd", "United States District Court for the Central District of California", "C.D. Cal.", "trial", True, 1966, ["Central District of California"]),
    ("ilnd", "United States District Court for the Northern District of Illinois", "N.D. Ill.", "trial", True, 1855, ["Northern District of Illinois"]),
    ("txsd", "United States District Court for the Southern District of Texas", "S.D. Tex.", "trial", True, 1902, ["Southern District of Texas"]),
    ("njd", "United States District Court for the District of New Jersey", "D.N.J.", "trial", True, 1789, ["District of New Jersey"]),
    ("gand", "United States District Court for the Northern District of Georgia", "N.D. Ga.", "trial", True, 1848, ["Northern District of Georgia"]),
    ("ny", "New York Court of Appeals", "N.Y.", "supreme", False, 1847, ["New York Court of Appeals"]),
    ("nyappdiv", "New York Supreme Court, Appellate Division", "App. Div.", "appellate", False, 1896, ["Appellate Division"]),
    ("njsuperapp", "New Jersey Superior Court, Appellate Division", "N.J. Super. Ct. App. Div.", "appellate", False, 1948, ["App. Div."]),
    ("illapp", "Illinois Appellate Court", "Ill. App. Ct.", "appellate", False, 1877, ["Illinois Appellate Court", "Ill. App."]),
    ("ill", "Supreme Court of Illinois", "Ill.", "supreme", False, 1818, []),
    ("texapp", "Texas Court of Appeals", "Tex. App.", "appellate", False, 1981, ["Texas Court of Appeals"]),
    ("tex", "Supreme Court of Texas", "Tex.", "supreme", False, 1846, ["Supreme Court of Texas"]),
    ("gactapp", "Court of Appeals of Georgia", "Ga. Ct. App.", "appellate", False, 1907, ["Georgia Court of Appeals", "Ga. App."]),
    ("ga", "Supreme Court of Georgia", "Ga.", "supreme", False, 1845, []),
    ("calctapp", "California Court of Appeal", "Cal. Ct. App.", "appellate", False, 1905, ["California Court of Appeal", "Cal. App."]),
    ("cal", "Supreme Court of California", "Cal.", "supreme", False, 1850, []),
]
# What stands in parentheses after a citation and names no court.
NON_COURT = ["en banc", "per curiam", "plurality opinion", "plurality", "concurring", "dissenting", "mem.", "summary order", "unpublished", "table", "emphasis added", "citation omitted", "citations omitted", "internal quotation marks omitted", "quoting", "cleaned up"]
EDITION_SCHEMA = "abbrev string, name string, series string, start int, end int, jurisdiction string"


def reporters(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """Editions with position, squash and annotations; table: rows of EDITION_SCHEMA instead of the listed or built-in set."""
    if table is None and (both := listed(spark)):
        table = both[0]
    if table is None:
        table = spark.createDataFrame([(*e, i) for i, e in enumerate(EDITIONS)], EDITION_SCHEMA + ", position int")
    elif "position" not in table.columns:
        table = table.withColumn("position", F.lit(0))
    return table.withColumns({"squash": squash(F.col("abbrev")), "scotus_only": F.col("abbrev").isin(SCOTUS_ONLY), "non_precedential": F.col("abbrev").isin(NON_PRECEDENTIAL)})


def variations(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """(written, canonical), the local spellings before those of table, or of the listed set."""
    if table is None and (both := listed(spark)):
        table = both[1]
    own = spark.createDataFrame(list(VARIATIONS.items()), "written string, canonical string")
    if table is not None:
        own = own.unionByName(table.select("written", "canonical").join(own.select("written"), "written", "left_anti"))
    return own.withColumn("squash", squash(F.col("written")))


def courts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, i) for i, c in enumerate(COURTS)], "id string, name string, abbrev string, level string, federal boolean, start int, aliases array<string>, position int").withColumn("end", F.lit(None).cast("int"))


# -- building the tables from a published list ---------------------------------------------------

JURISDICTIONS = {"federal": "federal", "state": "state", "neutral": "state", "state_regional": "regional", "scotus_early": "federal"}
FAMILY_SCHEMA = "cite_type string, name string, editions map<string, struct<start: string, end: string>>, variations map<string, array<string>>"


LIST_PATH, LIST_DIGEST = "spark.citegrid.reporters.path", "spark.citegrid.reporters.sha256"


def listed(spark: SparkSession) -> tuple[DataFrame, DataFrame] | None:
    """The published list that the session names, if it does: a path, and a digest that the file must have. All that asks for no table of its own then uses it."""
    path = spark.conf.get(LIST_PATH, None)
    return published_reporters(spark, path, spark.conf.get(LIST_DIGEST, None)) if path else None


def published_reporters(spark: SparkSession, path: str, sha256: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(editions, spellings) from a published list of reporters, a JSON file: series -> families with cite_type, name, editions, variations.

    With sha256 a file of another digest is refused. Pass the result to Engine(editions=, spellings=).
    """
    content = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest")).first()
    if sha256 is not None and content["digest"] != sha256.lower():
        raise ValueError(f"{path} has the digest {content['digest']}, not {sha256}")
    one = lambda x: [x] if isinstance(x, str) else list(x or [])
    rows = []
    for families in json.loads(bytes(content["content"]).decode("utf-8")).values():
        for f in families:
            editions = {a: ((d or {}).get("start"), (d or {}).get("end")) for a, d in f["editions"].items()}
            rows.append((f.get("cite_type"), f.get("name"), editions, {w: one(t) for w, t in (f.get("variations") or {}).items()}))
    families = spark.createDataFrame(rows, FAMILY_SCHEMA)
    editions = edition_table(families)
    return editions, variation_table(families, editions)


def table_statistics(families: DataFrame) -> DataFrame:
    """One row about a published list: families, editions in it, different abbreviations, ambiguous ones, usable spellings, dropped ones."""
    editions = edition_table(families)
    kept = variation_table(families, editions)
    given = families.select(F.explode("variations").alias("written", "targets"))
    per = families.agg(F.count("*").alias("families"), F.coalesce(F.sum(F.size("editions")), F.lit(0)).alias("listed"))
    all_ = editions.agg(F.count("*").alias("editions"), F.count_if("ambiguous").alias("ambiguous"))
    return per.crossJoin(all_).crossJoin(kept.agg(F.count("*").alias("spellings"))).crossJoin(given.agg(F.countDistinct("written").alias("_given"))).select("families", "listed", "editions", "ambiguous", "spellings", (F.col("_given") - F.col("spellings")).alias("dropped"))


def unmatched_annotations(editions: DataFrame) -> DataFrame:
    """(abbrev) of the annotations above that no edition of a table has; empty for a sound table."""
    wanted = editions.sparkSession.createDataFrame([(x,) for x in sorted({*SCOTUS_ONLY, *NON_PRECEDENTIAL})], "abbrev string")
    return wanted.join(editions.select("abbrev"), "abbrev", "left_anti")


def spellings_of(editions: DataFrame, spellings: DataFrame) -> DataFrame:
    """(spelt): every abbreviation and every other spelling, once."""
    return editions.select(F.col("abbrev").alias("spelt")).unionByName(spellings.select(F.col("written").alias("spelt"))).distinct()


def edition_table(families: DataFrame) -> DataFrame:
    """Families (FAMILY_SCHEMA, one row each) -> editions, repeated abbreviations merged.

    Of a repeated abbreviation the earliest start and the latest end hold, an open end before
    all others; the name is that of the earliest. Editions without dates start in 1600.
    """
    year = lambda c: F.expr(f"try_cast(left({c}, 4) as int)")
    kind = F.create_map(*[F.lit(x) for kv in JURISDICTIONS.items() for x in kv])
    rows = families.select("cite_type", "name", F.array_min(F.map_keys("editions")).alias("series"), F.explode("editions").alias("abbrev", "years"))
    rows = rows.select("abbrev", "name", "series", F.coalesce(year("years.start"), F.lit(1600)).alias("start"), year("years.end").alias("end"), F.coalesce(kind[F.col("cite_type")], F.lit("specialty")).alias("jurisdiction"))
    by = rows.groupBy("abbrev").agg(F.min_by("name", "start").alias("name"), F.min_by("series", "start").alias("series"), F.min("start").alias("start"), F.when(F.count_if(F.col("end").isNull()) == 0, F.max("end")).alias("end"), F.min_by("jurisdiction", "start").alias("jurisdiction"), (F.count("*") > 1).alias("ambiguous"))
    return by.withColumn("position", F.row_number().over(Window.orderBy(F.expr("abbrev collate UNICODE"))) - 1)  # one row per abbreviation: thousands at most


def variation_table(families: DataFrame, editions: DataFrame) -> DataFrame:
    """Spellings with exactly one target, that is an edition, and that are none themselves; the first in order wins."""
    rows = families.select(F.monotonically_increasing_id().alias("_at"), F.explode("variations").alias("written", "targets")).filter(F.size("targets") == 1).select("_at", "written", F.col("targets")[0].alias("canonical"))
    real = editions.select("abbrev")
    rows = rows.join(real, rows.canonical == real.abbrev, "left_semi").join(real, rows.written == real.abbrev, "left_anti")
    return rows.groupBy("written").agg(F.min_by("canonical", "_at").alias("canonical"))


def table_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(abbrev, change): added, removed or re-dated editions."""
    j = old.alias("o").join(new.alias("n"), F.col("o.abbrev") == F.col("n.abbrev"), "full")
    dates = lambda t: F.struct(F.col(f"{t}.start"), F.col(f"{t}.end"))
    change = F.when(F.col("o.abbrev").isNull(), "added").when(F.col("n.abbrev").isNull(), "removed").when(~dates("o").eqNullSafe(dates("n")), "re-dated")
    return j.select(F.coalesce("o.abbrev", "n.abbrev").alias("abbrev"), change.alias("change")).filter("change is not null")
