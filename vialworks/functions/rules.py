"""Rules on safety texts: what a text asks for, forbids or contradicts. All of built-in expressions."""

from __future__ import annotations

import re
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

from vialworks.functions import keys

#: Words of protective equipment, in lower case without blanks.
EQUIPMENT = {
    "goggles": ["보안경", "고글", "안면보호구", "보안면", "goggle", "safetyglasses", "faceshield"],
    "gloves": ["장갑", "glove"],
    "mask": ["마스크", "호흡보호구", "호흡용보호", "호흡기보호구", "방독", "공기호흡기", "respirator", "scba"],
    "suit": ["보호복", "보호의", "앞치마", "protectiveclothing", "apron"],
    "boots": ["안전화", "장화", "safetyshoes", "boots"],
}
#: Kinds of masks, and words of fire fighting.
MASKS = {"방독마스크": ["방독"], "방진마스크": ["방진"], "송기마스크": ["송기마스크", "공기호흡기", "에어라인", "scba"]}
FIRE = ["화재", "소화", "진압", "구조자", "소방"]
#: Headings of the equipment section, without blanks, longest first.
HEADINGS = [
    "노출방지및개인보호구", "인체를보호하기위해필요한조치사항및보호구", "화재진압시착용할보호구및예방조치", "화재진압시착용할보호구및", "화재진압시착용할보호구", "착용할보호구및예방조치",
    "한조치사항및보호구", "조치사항및보호구", "착용할보호구", "개인보호구(ppe)", "개인보호구", "personalprecautionsandprotectiveequipment", "personalprecautions,protectiveequipment", "및보호구", "보호구",
]
#: Advice to induce vomiting, and its negation.
VOMIT = r"(구토|토하)\S{0,3}\s*(유도|시키|일으키|하게\s*하|하도록)"
NO_VOMIT = r"(유도|시키|일으키|하게\s*하|하도록)\S{0,4}\s*(지\s*마|지\s*말|말\s*것|않|금지|안\s*됨|안\s*된다|불가)"
#: What counts as "no label element", without blanks.
NO_LABEL = ["해당없음", "유해화학물질로분류되지않음", "분류되지않음", "notclassified", "noghslabelelement", "notapplicable"]
#: Precaution codes by group, and words by group where no code decides.
PRECAUTION_CODES = {
    "storage": "P401 P402 P403 P404 P405 P406 P407 P410 P411 P412 P413 P420 P422".split(),
    "disposal": "P501 P502".split(),
    "response": (
        "P301 P302 P303 P304 P305 P306 P307 P308 P309 P310 P311 P312 P313 P314 P315 P320 P321 P322 P330 P331 P332 P333 P334 P335 P336 P337 P338 P340 P341 P342 "
        "P350 P351 P352 P353 P360 P361 P362 P363 P370 P371 P372 P373 P374 P375 P376 P377 P378 P380 P381 P390 P391"
    ).split(),
    "prevention": (
        "P201 P202 P203 P210 P211 P220 P221 P222 P223 P230 P231 P232 P233 P234 P235 P240 P241 P242 P243 P244 P250 P251 P260 P261 P262 P263 P264 P270 P271 P272 P273 "
        "P280 P281 P282 P283 P284 P285"
    ).split(),
}
PRECAUTION_WORDS = {
    "disposal": ["폐기", "폐기물", "법령에따라"],
    "storage": ["보관", "저장", "잠금", "환기가잘되는곳", "저온"],
    "response": ["삼켰", "흡입", "접촉", "노출", "화재", "불을끄", "의료", "응급", "씻", "오염된의복"],
    "prevention": ["사용전", "취급", "멀리하", "금연", "보호", "환기", "방폭", "정전기", "흡입을피"],
}
#: Words by which a worker is warned, group and number of the warning.
CAUTIONS = [
    ("work", 1, ["인화", "가연", "화재", "스파크", "화염", "flam", "fire"]),
    ("work", 2, ["분사", "도포", "혼합", "미스트", "mist"]),
    ("work", 3, ["고압가스", "gas", "cylinder"]),
    ("ppe", 1, ["보안경", "보호장갑", "호흡보호구", "보호구", "ppe", "goggle", "glove", "respir"]),
    ("ppe", 2, ["눈", "피부", "자극", "부식", "corros", "irrit"]),
    ("ppe", 3, ["호흡", "흡입", "유기용제", "용제", "vapor", "respir"]),
    ("ventilation", 1, ["증기", "미스트", "분진", "흡입", "호흡", "환기", "국소배기", "vapor", "mist", "dust", "inhal"]),
    ("ventilation", 2, ["톨루엔", "자일렌", "mibk", "butylacetate", "nbutylacetate", "ethylbenzene", "에틸벤젠", "부틸아세테이트", "유기용제", "용제"]),
    ("ventilation", 3, ["반복노출", "장기간", "신체손상", "노출"]),
    ("fireStorage", 1, ["제4류", "위험물", "인화성액체", "flammableliquid"]),
    ("fireStorage", 2, ["인화", "고온", "직사광선", "화기", "보관", "storage"]),
    ("fireStorage", 3, ["밀폐", "용기", "폐기", "disposal"]),
    ("legal", 1, ["관리대상", "작업환경측정", "특수건강진단"]),
    ("legal", 2, ["작업환경측정", "특수건강진단"]),
    ("legal", 3, ["cas", "casno", "관리대상", "성분"]),
]
#: Hazard codes by severity, gravest first.
SEVERITY = (
    "H200 H201 H202 H203 H204 H205 H220 H221 H222 H223 H224 H225 H226 H228 H240 H241 H242 H250 H251 H252 H260 H261 H270 H271 H272 H280 H281 H300 H301 H302 H310 H311 H312 H330 H331 H332 "
    "H314 H318 H340 H341 H350 H351 H360 H361 H362 H334 H370 H371 H372 H373 H304 H305 H400 H410 H411 H412 H413"
).split()
#: Pictograms by hazard class and category in the same part of a classification, or by code alone.
CLASSES = {
    "GHS01": [(["폭발성"], ["구분1", "구분2", "구분3", "구분4", "구분5"]), (["자기반응성", "유기과산화물"], ["구분a", "구분b"]), ([], ["h200", "h201", "h202", "h203", "h204", "h205"])],
    "GHS02": [
        (["인화성액체"], ["구분1", "구분2", "구분3"]),
        (["인화성가스", "인화성에어로졸", "인화성고체", "가연성가스", "자연발화성", "자기발열성", "물반응성"], ["구분1", "구분2"]),
        ([], ["h220", "h221", "h222", "h223", "h224", "h225", "h226", "h228", "h240", "h241", "h242", "h250", "h251", "h252", "h260", "h261"]),
    ],
    "GHS03": [(["산화성"], ["구분1", "구분2", "구분3"]), ([], ["h270", "h271", "h272"])],
    "GHS04": [([], ["고압가스", "압축가스", "액화가스", "냉동액화가스", "용해가스", "h280", "h281"])],
    "GHS05": [
        (["금속부식성", "금속부식성물질"], ["구분1"]),
        (["피부부식성", "피부부식성피부자극성"], ["구분1", "구분1a", "구분1b", "구분1c"]),
        (["심한눈손상성", "눈손상성눈자극성", "심한눈손상성눈자극성"], ["구분1"]),
        ([], ["h290", "h314", "h318"]),
    ],
    "GHS06": [(["급성독성"], ["구분1", "구분2", "구분3"]), ([], ["h300", "h301", "h310", "h311", "h330", "h331"])],
    "GHS07": [
        (["급성독성"], ["구분4"]),
        (["피부자극성", "피부부식성피부자극성"], ["구분2"]),
        (["눈자극성", "눈손상성눈자극성", "심한눈손상성눈자극성"], ["구분2", "구분2a"]),
        (["피부과민성"], ["구분1", "구분1a", "구분1b"]),
        (["특정표적장기독성1회노출"], ["구분3"]),
        ([], ["h302", "h312", "h315", "h317", "h319", "h332", "h335", "h336"]),
    ],
    "GHS08": [
        (["호흡기과민성"], ["구분1", "구분1a", "구분1b"]),
        (["생식세포변이원성", "변이원성"], ["구분1", "구분1a", "구분1b", "구분2"]),
        (["발암성"], ["구분1", "구분1a", "구분1b", "구분2"]),
        (["생식독성"], ["구분1", "구분1a", "구분1b", "구분2"]),
        (["특정표적장기독성1회노출", "특정표적장기독성반복노출"], ["구분1", "구분2"]),
        (["흡인유해성"], ["구분1", "구분2"]),
        ([], ["h304", "h334", "h340", "h341", "h350", "h351", "h360", "h361", "h370", "h371", "h372", "h373"]),
    ],
    "GHS09": [(["수생환경유해성급성", "급성수생환경유해성"], ["구분1"]), (["수생환경유해성만성", "만성수생환경유해성"], ["구분1", "구분2"]), ([], ["h400", "h410", "h411"])],
}


def holds(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\x{3000}\x{a0}]", "")


def sentences(c: Column) -> Column:
    """The sentences and items of a text, trimmed, without blank ones."""
    parts = F.split(F.regexp_replace(c, r"\s([가-하]\.)", "\n$1"), r"[.。!?;]\s*|\n+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def equipment(texts: Column) -> tuple[dict[str, Column], Column]:
    """(flags by kind of equipment, kind of mask if it is the only one named) of a list of texts. Sentences on fire
    fighting don't count. A null list names nothing."""
    kept = F.filter(F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: sentences(F.coalesce(t, F.lit(""))))), lambda s: ~holds(squeezed(s), FIRE))
    joined = squeezed(F.array_join(kept, " "))
    kinds = [F.when(holds(joined, ws), F.lit(k)) for k, ws in MASKS.items()]
    named = F.array_compact(F.array(*kinds))
    flags = {k: holds(joined, ws) for k, ws in EQUIPMENT.items()}
    return flags, F.when(flags["mask"], F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise(F.lit("호흡보호구")))


def without_markers(c: Column) -> Column:
    """A line without section numbers, bullets and item letters before it."""
    c = F.regexp_replace(c, r"(?i)^\s*section\s*[0-9]+\s*[–—:-]?\s*", "")
    c = F.regexp_replace(c, r"^\s*(?:[-–—•·*○●◦□■]\s*)+", "")
    return F.trim(F.regexp_replace(c, r"^\s*(?:[0-9]+(?:\.[0-9]+)*\.?|[0-9]+\)|[가-하]\.|[a-zA-Z]\.)\s*", ""))


def heading_pattern() -> str:
    """All headings, with blanks anywhere, as one pattern in their order."""
    return "|".join(r"\s*".join("\\" + ch if ch in "()," else ch for ch in h) for h in HEADINGS)


def equipment_candidate(c: Column) -> Column:
    """What an equipment line says after its heading; '' for a line that is only a heading or says there's no data."""
    c = without_markers(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    bare = F.regexp_replace(c, f"(?i)^(?:{heading_pattern()})", "")
    c = F.when(bare != c, F.trim(F.regexp_replace(bare, r"^\s*[:：\-–]\s*", ""))).otherwise(c)
    c = without_markers(c)
    rest = F.regexp_replace(squeezed(c), "[^0-9a-z가-힣]", "")
    return F.when((F.length(rest) < 4) | rest.startswith("자료없음"), F.lit("")).otherwise(c)


def vomit_conflict(hazards: Column, precautions: Column, ingestion: Column) -> Column:
    """The sentence of a first-aid text that has vomiting induced although H304, H314 or P331 stand in the other texts;
    null if there is none. Texts are joined by the caller."""
    parts = F.split(F.regexp_replace(F.coalesce(ingestion, F.lit("")), r"([.다오함])\s+", "$1\n"), "\n")
    bad = F.filter(parts, lambda s: s.rlike(VOMIT) & ~s.rlike(NO_VOMIT))
    why = holds(F.coalesce(hazards, F.lit("")), ["H304", "H314"]) | F.contains(F.coalesce(precautions, F.lit("")), F.lit("P331"))
    return F.when(why, F.trim(F.get(bad, F.lit(0))))


def no_label_element(c: Column) -> Column:
    return F.coalesce(holds(keys.search_key(c), NO_LABEL), F.lit(False))


def precaution_group(codes: Column, key: Column) -> Column:
    """The group of a precaution: by its codes, then by its words (`key`, the text's search key), then by the digits of its
    codes; '' without a code."""
    digits = F.transform(codes, lambda x: F.substring(x, 2, 1))
    by_code = reduce(lambda acc, g: acc.when(F.arrays_overlap(codes, F.array(*[F.lit(x) for x in PRECAUTION_CODES[g]])), F.lit(g)), PRECAUTION_CODES, F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, F.lit("")))
    by_word = reduce(lambda acc, g: acc.when(holds(key, PRECAUTION_WORDS[g]), F.lit(g)), PRECAUTION_WORDS, by_code)
    return reduce(lambda acc, x: acc.when(F.array_contains(digits, x[0]), F.lit(x[1])), [("4", "storage"), ("5", "disposal"), ("3", "response"), ("2", "prevention")], by_word).otherwise("")


def classification_parts(c: Column) -> Column:
    """The parts of a classification text in lower case, without blanks and marks, joined by ';'."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\n;；/]|,\s", ";"), " \t\x0b\f\r\n\u3000\xa0()[]·ㆍ:：-_,./", "")


def categories(parts: Column) -> Column:
    """Of classification_parts, those that can name a category."""
    stem = commonprefix([w for rs in CLASSES.values() for ns, cs in rs if ns for w in cs])
    return F.filter(F.split(parts, ";"), lambda x: F.contains(x, F.lit(stem)))


def hazard_codes(parts: Column) -> Column:
    """The hazard codes in classification_parts."""
    return F.regexp_extract_all(parts, F.lit("h[0-9]{3}"), F.lit(0))


def inferred_pictograms(key: Column, parts: Column, named: Column, codes: Column) -> Column:
    """Pictograms that a classification text asks for: a class and its category in one part, or a code anywhere. Empty
    where the text says there's no label element. The columns are search_key, classification_parts, categories and
    hazard_codes of the text; they stand many times in the result, so they should be columns of their own."""

    def both(ns: list[str], cs: list[str]):
        return lambda s: holds(s, ns) & holds(s, cs)

    def anywhere(ws: list[str]) -> list[Column]:
        coded = [w for w in ws if re.fullmatch("h[0-9]{3}", w)]
        words = [w for w in ws if w not in coded]
        return ([F.arrays_overlap(codes, F.array(*[F.lit(w) for w in coded]))] if coded else []) + ([holds(parts, words)] if words else [])

    def wanted(rules: list[tuple[list[str], list[str]]]) -> Column:
        return reduce(lambda a, b: a | b, [x for ns, cs in rules for x in ([F.exists(named, both(ns, cs))] if ns else anywhere(cs))])

    return F.when(holds(key, NO_LABEL), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(wanted(r), F.lit(g)) for g, r in CLASSES.items()])))


def cautions(key: Column) -> Column:
    """Numbers of the warnings, as group and number, that the words of a text's search key ask for; at most five a group.
    The key stands many times in the result, so it should be a column of its own."""
    return F.array_compact(F.array(*[F.when(holds(key, ws), F.lit(f"{g}{n}")) for g, n, ws in CAUTIONS]))


def severity(c: Column) -> Column:
    """The place of a statement's first hazard code by severity; behind all where it has none or another."""
    at = F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.regexp_extract(c, r"(?<![0-9A-Za-z_])H[0-9]{3}(?![0-9A-Za-z_])", 0))
    return F.when(at > 0, at).otherwise(len(SEVERITY) + 1)


def explicit_pictograms(label: Column, entry_label: Column, other: Column, other_is_fallback: Column, classified: Column, entry: Column) -> Column:
    """The first list that isn't empty: the document's label, the entry's label, the document's own unless it was only
    inferred, the entry's classification, the entry's own."""
    filled = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a)
    return F.coalesce(filled(label), filled(entry_label), F.when(~F.coalesce(other_is_fallback, F.lit(False)), filled(other)), filled(classified), filled(entry), F.array().cast("array<string>"))


def update_decision(old: Column, new: Column) -> Column:
    """fill an empty value, extend one that the new one contains, keep an equal or empty new one, conflict otherwise."""
    a, b = keys.search_key(F.coalesce(old, F.lit(""))), keys.search_key(F.coalesce(new, F.lit("")))
    return F.when(b == "", "keep").when(a == "", "fill").when(a == b, "keep").when(F.contains(b, a), "extend").otherwise("conflict")

