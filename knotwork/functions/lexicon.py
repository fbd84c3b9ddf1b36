"""Fixed values of record normalisation: spellings, word sets and patterns. Results depend on every one of them."""

from __future__ import annotations

# -- fixed values -----------------------------------------------------------------------------------------------------
PLACEHOLDERS = frozenset(["null", "none", "n/a", "na", "nan", "nil", "-", "--", "unknown"])

NAME_FORMS = {
    "corporation": "corp", "incorporated": "inc", "company": "co", "limited": "ltd", "private": "pvt", "and": "&", "et": "&", "cie": "co",
    "compagnie": "co", "societe": "ste", "society": "soc", "association": "assoc", "associates": "assoc", "services": "svc",
    "service": "svc", "international": "intl", "technologies": "tech", "technology": "tech", "enterprises": "ent", "enterprise": "ent",
    "industries": "ind", "industry": "ind", "brothers": "bros", "center": "ctr", "centre": "ctr", "groupe": "group",
    "etablissements": "ets", "saint": "st", "sainte": "ste", "frs": "freres", "pvtltd": "pvt ltd",
}

LEGAL = frozenset("inc corp co ltd pvt llc llp lp plc pllc pc pa sarl sas sasu sa eurl sci snc scop selarl gie ets group holdings holding partners & the of ms m ei".split())
HONORIFIC = frozenset("dr smt sri shri shree mr mrs ms the messrs".split())
NAME_STOP = frozenset("the of de du la le les des d l & a an".split())
LEGAL_WORDS = LEGAL - {"the", "of", "&", "m", "ms"}
LEGAL_FORMS = frozenset("inc corp co ltd pvt llc llp lp plc pllc pc pa sarl sas sasu sa eurl sci snc scop selarl gie".split())
STRONG_ADDITIONS = frozenset(["group", "holding", "holdings"])

ADDRESS_FORMS = {
    # English street words
    "road": "rd", "street": "st", "avenue": "ave", "av": "ave", "avn": "ave", "boulevard": "blvd", "bd": "blvd", "boul": "blvd",
    "drive": "dr", "court": "ct", "lane": "ln", "place": "pl", "terrace": "ter", "trail": "trl", "circle": "cir", "highway": "hwy",
    "parkway": "pkwy", "square": "sq", "suite": "ste", "apartment": "apt", "building": "bldg", "floor": "flr", "north": "n", "south": "s",
    "east": "e", "west": "w", "mount": "mt", "fort": "ft", "saint": "st", "sainte": "ste", "township": "twp", "point": "pt",
    "heights": "hts", "junction": "jct",
    # French street words
    "rue": "r", "allee": "all", "alle": "all", "impasse": "imp", "chemin": "che", "route": "rte", "faubourg": "fbg", "quai": "qu",
    "residence": "res", "cite": "cite", "general": "gen", "marechal": "mal", "president": "pdt", "docteur": "dr",
    # Indian address words
    "nagar": "ngr", "colony": "col", "sector": "sec", "near": "nr", "opposite": "opp", "opp": "opp", "industrial": "ind", "area": "area",
    "village": "vill", "vil": "vill", "district": "dist", "dt": "dist", "post": "po", "marg": "marg", "cross": "crs", "main": "main",
    "block": "blk", "phase": "ph", "extension": "extn", "ext": "extn",
    # more French street and building words
    "ch": "che", "chem": "che", "cours": "crs", "q": "qu", "passage": "psg", "pass": "psg", "bld": "blvd", "bvd": "blvd", "bldv": "blvd",
    "chaussee": "chs", "chee": "chs", "promenade": "prom", "lotissement": "lot", "hameau": "ham", "esplanade": "esp", "fg": "fbg",
    "resid": "res", "app": "apt", "appt": "apt", "appartement": "apt", "etage": "flr", "etg": "flr", "bat": "bldg", "batiment": "bldg",
}
ADDRESS_NOISE = frozenset("no door hno house unit apt ste pmb po box flat dno shop office plot bis ter quater b".split())
STREET_TYPES = (
    "rue avenue boulevard chemin allee impasse route place quai cours cour passage square residence cite faubourg chaussee promenade "
    "lotissement hameau sentier sente esplanade parvis villa plage cote"
).split()

ALIAS = r"\s+(?:d\.?/?b\.?/?a\.?:?|doing business as|trading as|t/a|a/k/a|aka|f/k/a|fka|formerly known as|formerly|nee|née)\s+"
WEB_HOST = r"(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co|fr|biz|info|us|co\.in)"
NAME_JUNK = r"\((?:id|ref|no)[^)]*\)|#\s*\d{4,}|\bid\s*[:#]\s*\d+"
LONG_NUMBER = r"\b\d{5,}\b"
NUMERO = r"\bn\s*[°º]\s*|\bno\.?\s*(?=\d)|#\s*(?=\d)"
NUMBER_SUFFIX = r"\b(\d+)\s*(?:bis|ter|quater|[bt])\b(?!\.)"
NOT_TOKEN = r"[^0-9a-zऀ-෿]+"

DECOY_OFFSETS = frozenset([1, 2, 3, 4, 5, 7, 9, 11, 13, 21])
DECOY_NOISE = frozenset("svc ctr dba formerly fka aka as nee ta doing business known com www trading".split())
WEAK_STREET = frozenset(
    "r rue ave blvd che all imp rte pl qu crs psg sq res cite fbg de du des la le les d l st ste rd dr ln ct way pkwy hwy cir ter trl n s e w "
    "main ngr col sec marg blk ph gen".split()
)
AMBIGUOUS_SWAPS = frozenset("ctr france ste gestion conseil fils freres associes associe".split())
LINK_CAPS = {2: 5, 3: 6}
# -- end of fixed values ----------------------------------------------------------------------------------------------
