"""Citations of a graded quiz, with the rules that must speak on each; on all others the engine is silent."""

# Test texts that any implementation must grade alike (text, rules that speak).
GRADED = [
    ("Lee v. State, 43 N.E.3d 1271 (Ind. 2015).", []),
    ("GEICO Gen. Ins. Co. v. Coyne, 7 N.E.3d 300 (Ind. Ct. App. 2014).", []),
    ("GEICO General Insurance Co. v. Coyne, 7 N.E.3d 300 (Ind. Ct. App. 2014).", []),
    ("U.S v. Wilson, 502 F.3d 718 (7th Cir. 2007).", []),
    ("United States v. Wilson, 502 F.3d 718 (7th Cir. 2007).", []),
    ("United States v. Wilson, 502 F.3d 718 (C.A. 7. 2007).", ["CT001"]),
    ("United States v. Wilson, 502 F.3d 718 (2007).", []),
    ("L.O. ex rel. D.O. v. E. Allen Cty. Sch. Corp., 58 F.3d 882 (N.D. Ind. 2014).", []),
    ("L.O. in re D.O. v. E. Allen Cty. Sch. Corp., 58 F. Supp. 3d 882 (N.D. Ind. 2014).", []),
    ("L.O. ex rel. D.O. v. E. Allen Cty. Sch. Corp., 58 F. Supp. 3d 882 (N.D. Ind. 2014).", []),
    ("L.O. in re D.O. v. E. Allen Cty. Sch. Corp., 58 F. Supp. 3d 882 (N. Dist. Ind. 2014).", []),
    ("Cleveland v. Policy Mgmt. Sys. Corp., 526 U.S. 795 (1999).", []),
    ("Cleveland v. Policy Management Systems Corp., 119 S. Ct. 1597 (1999).", []),
    ("Cleveland v. Policy Management Sys. Corp., 526 U.S. 795 (U.S. 1999).", ["CT005"]),
    ("Blasius v. Angel Auto., Inc., No. 15-2994, 2016 WL 5929824, at *6 (7th Cir. Oct. 12, 2016).", []),
    ("Griggs v. State Farm Lloyds, 181 F.3d 694 (5th Cir. 1999). The court reached the opposite conclusion in Rico v. Flores, 481 F.3d 234 (5th Cir. 2007). Griggs, 181 F.3d at 700-01 (1999).", ["ST005"]),
    ("Griggs v. State Farm Lloyds, 181 F.3d 694 (5th Cir. 1999). The court reached the opposite conclusion in Rico v. Flores, 481 F.3d 234 (5th Cir. 2007). Griggs, 181 F.3d at 700-01.", []),
    ("Rico v. Flores, 481 F.3d 234, 237 (5th Cir. 2007). Id. at 240.", []),
    ("Fruth v. Lear, 688 A.2d 35, 38 (Pa. 1998) (holding that the defendant breached the contract).", []),
    ("Fruth v. Lear, 688 A.2d 35, 38 (Pa. 1998) (held that the defendant breached the contract).", []),
    ("Fed. R. Civ. P. 12(b)(6).", []),
    ("17 U.S.C. § 501 (2012 & Supp. II 2014).", []),
    ("18 U.S.C. §§ 1544, 1546 (2012).", []),
    ("18 U.S.C. § 1544, 1546 (2012).", ["ST006"]),
    ("18 U.S.C. §§ 1544, 1546.", []),
    ("The court had jurisdiction under 28 U.S.C. § 1331 (2006). See Rico v. Flores, 481 F.3d 234 (5th Cir. 2007). Diversity jurisdiction is governed by § 1332.", []),
    ("42 U.S.C. § 1983 (2012). Id. § 1985.", []),
    ("17 U.S.C. § 103-07 (2012).", ["ST006", "ST007"]),
    ("17 U.S.C. §§ 103-07 (2012).", ["ST007"]),
    ("17 U.S.C. § 103-107 (2012).", ["ST006"]),
    ("17 U.S.C. §§ 103-107 (2012).", []),
    ("Ind. Code § 22-5-3-2 (2012).", []),
    ("Michael S. Schmidt & Richard Sandomir, Baseball Taking Control of Dodgers’ Operations, N.Y. Times, Apr. 21, 2011, at B2.", []),
    ("Charles P. Cercone, The War Against Work Product Abuse: Exposing the Legal Alchemy of Document Compilations As Work Product, 64 U. Pitt. L. Rev. 639 (2003).", []),
    ("Elizabeth Fajans & Mary R. Falk, Scholarly Writing for Law Students 25 (4th ed. 2011).", []),
]
