"""Normalizers, parsers and similarity as Column expressions (JVM-side)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in the names of people, organizations and committees that are matched.
STOP_WORDS = [
    "the", "of", "for", "and", "in", "inc", "llc", "ltd", "co", "corp", "corporation", "company", "assoc", "association", "assn", "group",
    "committee", "fund", "pac", "political", "action", "a", "an",
]
#: The profile resolver's two sets, legal forms and words that say nothing.
LEGAL_FORMS = ["inc", "llc", "ltd", "co", "corp", "corporation", "company", "assoc", "association", "assn", "group", "pllc", "llp", "lp"]
PROFILE_STOP_WORDS = ["the", "of", "for", "and", "in", "a", "an", "to", "committee", "fund", "pac", "political", "action"]
#: Words of addresses and their short forms.
ADDRESS_WORDS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "terrace": "ter", "suite": "ste", "apartment": "apt",
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
#: Name suffixes that are no person by themselves.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "esq"]
#: Spending categories in order, with the parts of words that decide; the first that occurs wins.
CATEGORIES = [
    ("media_advertising", ["advertis", "media", "digital", "facebook", "google", "youtube", "radio", "television", "tv", "mail", "mailer", "billboard"]),
    ("consulting_professional", ["consult", "strateg", "advis", "poll", "research", "analytics", "data", "professional service"]),
    ("legal_compliance", ["legal", "attorney", "law", "compliance", "filing", "accounting", "audit", "treasurer"]),
    ("travel_events", ["travel", "hotel", "flight", "airfare", "uber", "lyft", "mileage", "event", "venue", "catering"]),
    ("payroll_staff", ["salary", "payroll", "wage", "stipend", "staff", "contract labor", "compensation"]),
    ("fundraising", ["fundraising", "fundraiser", "donation platform", "ticket", "actblue"]),
    ("printing_postage", ["print", "printing", "postage", "brochure", "flyer"]),
    ("office_admin", ["rent", "office", "supplies", "phone", "internet", "utilities", "software", "license", "subscription"]),
]
#: Nicknames and the names they stand for; read both ways, not chained.
NICKNAMES = {
    "MIKE": ["MICHAEL"], "TOM": ["THOMAS"], "BOB": ["ROBERT"], "ROB": ["ROBERT"], "BILL": ["WILLIAM"], "WILL": ["WILLIAM"], "JIM": ["JAMES"], "DAN": ["DANIEL"],
    "SAM": ["SAMUEL", "SAMANTHA"], "CHUY": ["JESUS"], "JB": ["JAY ROBERT"], "PAT": ["PATRICK", "PATRICIA"], "TONY": ["ANTHONY"], "CHRIS": ["CHRISTOPHER", "CHRISTINE"],
    "LIZ": ["ELIZABETH"], "BETH": ["ELIZABETH"], "KATE": ["KATHERINE", "KATHLEEN"], "KATIE": ["KATHERINE", "KATHLEEN"], "JOE": ["JOSEPH"], "DAVE": ["DAVID"],
    "STEVE": ["STEVEN", "STEPHEN"], "RICK": ["RICHARD"], "DICK": ["RICHARD"], "ED": ["EDWARD"], "TED": ["THEODORE", "EDWARD"], "JEFF": ["JEFFREY"], "MATT": ["MATTHEW"],
    "NICK": ["NICHOLAS"], "ALEX": ["ALEXANDER", "ALEXANDRA"], "JEN": ["JENNIFER"], "JENNY": ["JENNIFER"], "SUE": ["SUSAN"], "PEG": ["MARGARET"], "PEGGY": ["MARGARET"],
}
#: Party words and codes.
PARTIES = {"DEMOCRAT": "DEM", "DEMOCRATIC": "DEM", "REPUBLICAN": "REP", "INDEPENDENT": "IND", "OTHER": "OTH", "GREEN": "GRE", "LIBERTARIAN": "LIB"}


def aliases() -> dict[str, list[str]]:
    """First names, lower case, with their direct aliases in both directions."""
    out: dict[str, list[str]] = {}
    for short, full in NICKNAMES.items():
        for name in full:
            out.setdefault(short.lower(), []).append(name.lower())
            out.setdefault(name.lower(), []).append(short.lower())
    return out


def clean(c: Column) -> Column:
    """Null for blanks, else trimmed."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Lower case, signs to blanks, blanks to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def canonical_org(c: Column) -> Column:
    """Punctuation and legal forms removed, as in a variant rollup."""
    bare = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[.,#'&-]", "")
    return F.trim(F.regexp_replace(bare, r"\b(?:LLC|INC|CORP)\b", ""))


def tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of a normalized name without stop words; empty array for none."""
    words = F.filter(F.split(normalize_name(c), " "), lambda w: w != "")
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)])))


def profile_name(c: Column) -> Column:
    """Lower case, `&` as a word, signs to blanks, without legal forms."""
    words = F.split(normalize_name(F.regexp_replace(c, "&", " and ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(LEGAL_FORMS)), " ")


def profile_address(c: Column) -> Column:
    """The same for an address, its words in their short forms."""
    short = F.create_map(*[F.lit(x) for kv in ADDRESS_WORDS.items() for x in kv])
    words = F.filter(F.split(normalize_name(F.regexp_replace(c, "&", " and ")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(short, w), w)), " ")


def city_key(city: Column, state: Column) -> Column:
    return F.concat_ws(", ", F.initcap(F.coalesce(clean(city), F.lit("Unknown"))), F.upper(F.coalesce(clean(state), F.lit("??"))))


def spending_category(purpose: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """First category, in order, one of whose keywords is a substring; `uncategorized` if none is or the text is blank."""
    low = F.lower(F.coalesce(purpose, F.lit("")))
    out = F.when(F.trim(low) == "", F.lit("uncategorized"))
    for name, words in rules or CATEGORIES:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("uncategorized"))


def parse_amount(c: Column) -> Column:
    """Money from text: currency signs and thousands separators dropped, parentheses or a leading minus negative; null if none.

    A date in the same cell is not an amount.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"\d{1,4}[/-]\d{1,2}[/-]\d{2,4}", " "), r"[$,\s]", "")
    digits = F.regexp_extract(bare, r"(\d+(?:\.\d+)?|\.\d+)", 1)
    value = F.expr("1") * F.nullif(digits, F.lit("")).try_cast("double")
    return F.when(bare.rlike(r"^\(.*\)$") | bare.startswith("-"), -value).otherwise(value)


DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "MM-dd-yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy"]


def parse_date(c: Column) -> Column:
    """First format that fits, then a date found inside the text; null if none."""
    text = F.trim(c)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    inside = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("")), F.lit("M/d/yyyy"))
    iso = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd"))
    return F.to_date(F.coalesce(*tries, inside, iso))


def canonical_url(c: Column) -> Column:
    """Lower-case host without www or m, path without a last slash, no query or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/]*)", 1)), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1), r"/+$", "")
    return F.concat(host, path)


def name_matches(c: Column, search: str, min_prefix: int = 1) -> Column:
    """Every word of the search, or one of its nickname aliases, is a prefix of some word of the name; blanks match nothing.

    A word with an apostrophe inside ("O'Neil") asks for the joined word or for its halves next to each other and in order (a half of one letter as a whole word),
    and has no aliases. Letters alone in a search with longer words are left out, and a possessive 's counts as the word itself.
    """
    words = [re.sub(r"'s$", "", w) for w in re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)*", search.lower().replace("\u2019", "'"))]
    if any(len(w) > 1 for w in words):
        words = [w for w in words if len(w) > 1 or not w.isalpha()]
    words = [w for w in words if len(w) >= min_prefix]
    if not words:
        return F.lit(False)
    parts, known = F.split(normalize_name(c), " "), aliases()
    has = lambda w: F.exists(parts, lambda p: p.startswith(w))
    found = []
    for w in words:
        if "'" in w:
            halves = w.split("'")
            at = lambda i, h: F.get(parts, i) == h if len(h) == 1 else F.coalesce(F.get(parts, i).startswith(h), F.lit(False))
            beside = F.exists(F.sequence(F.lit(0), F.size(parts)), lambda i: reduce(lambda a, b: a & b, [F.coalesce(at(i + k, h), F.lit(False)) for k, h in enumerate(halves)]))
            found.append(has("".join(halves)) | beside)
        else:
            options = [reduce(lambda a, b: a & b, [has(x) for x in name.split()]) for name in [w, *known.get(w, [])]]
            found.append(reduce(lambda a, b: a | b, options))
    return reduce(lambda a, b: a & b, found)


def contains_fallback(c: Column, search: str, least: int = 4) -> Column:
    """What a search falls back to if no name matches: its words in order anywhere in the text; false for fewer than `least` letters."""
    words = re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)*", search.lower())
    if len(" ".join(words)) < least:
        return F.lit(False)
    return F.coalesce(F.lower(c).like("%" + "%".join(w.replace("'", "_") for w in words) + "%"), F.lit(False))


def people(c: Column) -> Column:
    """Persons named in one cell: parts between `;`, `/` or ` and `; a sole `Last, First` is one person; suffixes and repeats go."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+(?:and|&)\s+", ";")
    parts = F.transform(F.split(text, r"[;/]"), lambda p: F.trim(p))
    turned = F.transform(parts, lambda p: F.when(p.rlike(r"^[^,]+,[^,]+$"), F.concat_ws(" ", F.trim(F.split_part(p, F.lit(","), F.lit(2))), F.trim(F.split_part(p, F.lit(","), F.lit(1))))).otherwise(p))
    return F.array_distinct(F.filter(turned, lambda p: (p != "") & ~p.isin(SUFFIXES)))


def name_key(c: Column) -> Column:
    """First and last word of a normalized name, without suffixes."""
    words = F.filter(F.split(normalize_name(c), " "), lambda w: (w != "") & ~w.isin(SUFFIXES))
    return F.when(F.size(words) > 0, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)))


def name_keys(c: Column) -> Column:
    """The name key and those with a direct nickname alias of one word in place of the first name; two names agree if a key of one is the key of the other."""
    key = name_key(c)
    known = F.create_map(*[F.lit(x) for k, v in aliases().items() if " " not in k for x in (k, "|".join(n for n in v if " " not in n))])
    first, last = F.split_part(key, F.lit(" "), F.lit(1)), F.split_part(key, F.lit(" "), F.lit(2))
    other = F.filter(F.split(F.coalesce(F.element_at(known, first), F.lit("")), r"\|"), lambda n: n != "")
    return F.when(key.isNotNull(), F.array_distinct(F.concat(F.array(key), F.transform(other, lambda n: F.concat_ws(" ", n, last)))))


def split_metadata(c: Column) -> Column:
    """struct(name, occupation, employer) of a cell such as `Name Occupation: x Employer: y`, the two in any order; without marks the whole cell is the name."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    strip = lambda x: F.regexp_replace(x, r"^[ \-;,]+|[ \-;,]+$", "")
    bare = strip(F.regexp_extract(text, r"(?i)^(.*?)(?:occupation|employer)\s*:", 1))
    name = F.when(text.rlike(r"(?i)(?:occupation|employer)\s*:") & (bare != ""), bare).otherwise(text)
    part = lambda own, other: F.nullif(strip(F.regexp_extract(text, rf"(?i){own}\s*:\s*(.*?)(?:{other}\s*:|$)", 1)), F.lit(""))
    return F.struct(name.alias("name"), part("occupation", "employer").alias("occupation"), part("employer", "occupation").alias("employer"))


def is_noise_name(c: Column) -> Column:
    """Whether a name is blank or only digits, dots and blanks, as page numbers are."""
    return F.coalesce(F.regexp_replace(c, "[\\s\u00a0]+", ""), F.lit("")).rlike("^[\\d.\u2026]*$")


def office_code(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.contains("house"), "H").when(low.contains("senate"), "S").when(low.contains("president"), "P")


def district_code(c: Column, office: Column) -> Column:
    """Two digits at the end of a House district; null for other offices."""
    digits = F.regexp_extract(F.trim(c), r"(\d{1,2})$", 1)
    return F.when((office == "H") & (digits != ""), F.lpad(digits, 2, "0"))


def party_code(c: Column) -> Column:
    """Three-letter code of a party: a code as it is, a known word's code, else null."""
    text = F.upper(F.trim(c))
    return F.when(F.length(text) == 3, text).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in PARTIES.items() for x in kv]), text))


def zip5(c: Column) -> Column:
    """First five digits in a row, or the empty text."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{5})", 1)


def race_key(*parts: Column) -> Column:
    """Lower-case runs of letters and digits of all parts, joined by hyphens; null and blank parts add nothing."""
    text = F.concat_ws(" ", *[p.cast("string") for p in parts])
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def canonical_race_key(c: Column) -> Column:
    """A race key without the ten hex digits that older keys ended in."""
    return F.regexp_replace(c, r"-[0-9a-f]{10}$", "")


def trigrams(c: Column) -> Column:
    """Distinct letter triples of each word with two blanks in front and one behind, lower case."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over united elements of two arrays of distinct elements; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def size_band(amount: Column) -> Column:
    return F.when(amount < 200, "under_200").when(amount < 1000, "200_to_999").when(amount < 5000, "1000_to_4999").otherwise("5000_up")
