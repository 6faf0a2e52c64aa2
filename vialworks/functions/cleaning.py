"""Cleaning of catalogue fields: dates, companies, names, contacts, amounts, statements. All of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vialworks.functions import keys

#: Forms of dates, year first, day first, and with the month before its sign.
YMD = r"(?:19|20)[0-9]{2}\s*(?:[.\-/]|년)\s*[0-9]{1,2}\s*(?:[.\-/]|월)\s*[0-9]{1,2}"
DMY = r"[0-9]{1,2}\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*(?:19|20)[0-9]{2}"
KOREAN = r"[0-9]{1,2}\s*[0-9]{1,2}\s*월\s*(?:19|20)[0-9]{2}"
#: Texts that stand where a date should be.
NO_DATE = r"^\s*(?:-|자\s*:?|년\s*월\s*일|신규\s*생산일|개정\s*횟수|최종\s*개정일)?\s*$|자료\s*없음|해당\s*없음|개정\s*횟수\s*및\s*최종\s*개정일자"
#: Legal forms, labels before a company, and where an address or contact begins.
LEGAL = r"㈜|\(주\)|주식회사|\(유\)|유한회사"
COMPANY_LABEL = r"(?i)^(?:/|제조사/공급업체|제조자/공급업체|공급자\s*정보|제조자\s*정보|회사명)\s*[:：]?"
REGIONS = "서울|경기|인천|강원|충북|충청북도|충남|충청남도|대전|세종|전북|전라북도|전남|전라남도|광주|경북|경상북도|경남|경상남도|대구|울산|부산|제주"
AFTER_COMPANY = r"주\s*소|긴급|전화|tel|fax|담당|연락|정보제공|제품명|권고|사용상|유해|위험|2\.|나\.|다\.|○"
#: Where another section begins in a supplier's field, and texts that are only a label.
NEXT_SECTION = r"[○●◎]|유해성\s*[·ㆍ]?\s*위험성|그림\s*문자|예방\s*조치|신\s*호\s*어|구성성분"
ADDRESS_END = NEXT_SECTION + r"|긴급\s*(?:연락|전화)|FAX|담당\s*부서|작성\s*부서|정보\s*제공"
ONLY_LABELS = ["신호어", "그림문자", "제품명", "공급자", "공급자 정보", "회사명", "주소", "-", "자료없음"]
#: Identifiers of a source that are no registry numbers.
SOURCE_NUMBER = r"(?<![0-9A-Za-z_-])(?:T-[0-9]{4}-[0-9]+(?:\([0-9]{4}-[0-9]{2}-[0-9]{2}\))?|KE-[0-9]+|Z[0-9]+-[0-9]+|[0-9]{2,4}-[0-9]-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9])(?![0-9A-Za-z_-])"
#: Words of file names that say nothing about the product.
FILE_WORDS = ["msds", "sds", "pdf", "2020", "2021", "2022", "2023", "2024", "2025"]
#: Korean endings of sentences, and nouns that end like one.
ENDINGS = ["시오", "것", "다"]
M_NOUNS = ["흄", "사람", "바람", "몸", "힘", "늄", "륨", "슘", "뮴", "롬"]
#: Terms before which a product name gets a blank.
TERMS = ["구두약", "세척제", "접착제", "이형제", "방청제", "윤활제", "페인트", "프라이머", "신너"]


def spaces(c: Column) -> Column:
    """Single blanks, none around."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{3000}\x{a0}]+", " "))


def _parts(date: Column, order: tuple[int, int, int]) -> Column:
    n = F.regexp_extract_all(date, F.lit("[0-9]+"), F.lit(0))
    return F.format_string("%s-%02d-%02d", F.get(n, F.lit(order[0])), F.get(n, F.lit(order[1])).cast("int"), F.get(n, F.lit(order[2])).cast("int"))


def written_date(date: Column) -> Column:
    """year-month-day of one date in any of the three forms; null for other texts."""
    month_first = F.regexp_extract(date, r"^([0-9]{1,2})\s*([0-9]{1,2})\s*월", 2)
    days = F.regexp_extract(date, r"^([0-9]{1,2}?)\s*([0-9]{1,2})\s*월", 1)
    korean = F.format_string("%s-%02d-%02d", F.regexp_extract(date, r"((?:19|20)[0-9]{2})\s*$", 1), month_first.try_cast("int"), days.try_cast("int"))
    return F.when(date.rlike(f"^{YMD}"), _parts(date, (0, 1, 2))).when(date.rlike(f"^{DMY}"), _parts(date, (2, 1, 0))).when(date.rlike(f"^{KOREAN}"), korean)


def clean_date(c: Column) -> Column:
    """The last date of a text that the calendar has, as year-month-day; '' for placeholders, no date and wrong dates."""
    v = F.regexp_replace(F.regexp_replace(spaces(c), r"^(?:최종\s*)?개정\s*일자?\s*[:：]?\s*", ""), r"^자\s*[:：]?\s*", "")
    found = F.regexp_extract_all(v, F.lit(f"{YMD}|{DMY}|{KOREAN}"), F.lit(0))
    last = written_date(F.get(found, F.size(found) - 1))
    return F.when(spaces(c).rlike(NO_DATE), F.lit("")).otherwise(F.coalesce(F.when(F.try_to_timestamp(last, F.lit("yyyy-MM-dd")).isNotNull(), last), F.lit("")))


def shown_date(c: Column) -> Column:
    """The first date with its year first, else the first day-first one, as it stands; the calendar isn't asked."""
    v = F.regexp_replace(spaces(c), r"^(?:최종\s*)?개정\s*일자?\s*[:：]?\s*", "")
    first = F.coalesce(*[F.when(v.rlike(p), written_date(F.regexp_extract(v, f"({p})", 1))) for p in (YMD, DMY)], F.lit(""))
    return F.when(spaces(c).rlike(NO_DATE), F.lit("")).otherwise(first)


def company(c: Column) -> Column:
    """A company's name without legal forms, labels, parentheses, and what follows it; '' where none is left."""
    v = F.regexp_replace(spaces(c), COMPANY_LABEL, "")
    v = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"^[0-9]+_\s*", ""), r"\([^)]*\)", ""), LEGAL, ""))
    for stop in (f"(?:{REGIONS})", f"(?i)(?:{AFTER_COMPANY})"):
        v = F.trim(F.regexp_extract(v, rf"^(.+?)(?={stop}|$)".replace("(?=(?i)", "(?i)(?="), 1))
    v = F.trim(F.regexp_replace(v, "[,:：;/]+$", ""))
    bad = (F.length(v) > 45) | v.rlike(r"(?i)^[0-9]{2,7}-[0-9]{2,3}-[0-9]{1,4}$|CAS\s*(?:No\.?)?\s*(?:미기재|없음)|자료없음|해당없음|업체\s*미확인|[0-9]{2,4}\)?\s*[0-9]{3,4}[-\s][0-9]{4}|도로|로\s*[0-9]|길\s*[0-9]|번길|산단로")
    return F.when(bad, F.lit("")).otherwise(v)


def product_of_file(c: Column) -> Column:
    """A product's name from its file name: without dates, versions, revisions and the words of safety sheets."""
    v = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.pdf$", ""), "_+", " ")
    for p in (r"(?i)(?<![0-9A-Za-z])(?:msds|ghs)(?![0-9A-Za-z])", r"(?<![0-9])[0-9]{4}[-_.]?[0-9]{2}[-_.]?[0-9]{2}(?![0-9])", r"(?<![0-9])[0-9]{2}[-_.][0-9]{2}[-_.][0-9]{2}(?![0-9])", r"(?i)(?<![0-9A-Za-z])(?:ver(?:sion)?|rev(?:ision)?)\s*[0-9]+[a-z]?(?![0-9A-Za-z])", r"[0-9]+\s*차\s*개정", r"\s+[-–—]+\s+"):
        v = F.regexp_replace(v, p, " ")
    v = F.regexp_replace(v, rf"([^\s(])({'|'.join(TERMS)})", "$1 $2")
    return spaces(F.regexp_replace(F.regexp_replace(v, r"\s+\)", ")"), r"\(\s+", "("))


def supplier_field(c: Column, end: str, most: int) -> Column:
    """A supplier's field up to where another section begins, at most `most` characters; '' for a label only."""
    v = spaces(c)
    head = F.regexp_extract(v, rf"^(.+?)(?:{end})", 1)
    v = F.when(head != "", F.regexp_replace(head, r"^[\s,;·-]+|[\s,;·-]+$", "")).otherwise(v)
    v = F.when(F.length(v) > most, F.concat(F.rtrim(F.substring(v, 1, most)), F.lit("…"))).otherwise(v)
    return F.when(spaces(c).isin(*ONLY_LABELS), F.lit("")).otherwise(v)


def coded_only(c: Column, code: str = "H") -> Column:
    """The lines of a list that hold a code, if any does; else all that aren't blank."""
    lines = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), spaces), lambda x: x != "")
    coded = F.filter(lines, lambda x: x.rlike(rf"(?<![0-9A-Za-z_가-힣]){code}[0-9]{{3}}(?![0-9A-Za-z_가-힣])"))
    return F.when(F.size(coded) > 0, coded).otherwise(lines)


def shown_text(c: Column) -> Column:
    """Single blanks, and one after a stop and before a code."""
    v = F.regexp_replace(spaces(c), r"([.!?。])(?=\S)", "$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(v, r"([가-힣)])([PH][0-9]{3})", "$1 $2"), r"\)\s*\(", ") ("))


def display_items(c: Column) -> Column:
    """The parts of a text between line breaks, semicolons, middle dots and bullets, each with single blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*(?:\n+|[;；]|ㆍ|•)\s*"), shown_text), lambda x: x != "")


def by_codes(c: Column, letter: str) -> Column:
    """A text cut before every code if it holds more than one; what stands before the first is left out then."""
    v = shown_text(c)
    pattern = f"{letter}[0-9]{{3}}(?:\\+{letter}?[0-9]{{3}})*"
    n = F.size(F.regexp_extract_all(v, F.lit(f"(?i){pattern}"), F.lit(0)))
    parts = F.filter(F.transform(F.split(F.regexp_replace(v, f"(?i)({pattern})", "\n$1"), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(f"(?i)^{letter}[0-9]{{3}}"))
    return F.when(n > 1, parts).otherwise(F.array(v))


def statement(c: Column) -> Column:
    """(code, text) of a statement: its first code with what is joined to it, and the rest without bullets and labels."""
    v = spaces(c)
    code = F.regexp_extract(v, r"([HP][0-9]{3}(?:\s*\+\s*[HP]?[0-9]{3})*)", 1)
    rest = F.regexp_replace(v, r"[HP][0-9]{3}(?:\s*\+\s*[HP]?[0-9]{3})*", " ")
    rest = F.regexp_replace(rest, r"^\s*(?:[-–—•·*:：]\s*)+", "")
    rest = F.regexp_replace(rest, r"^\s*(?:예방|대응|저장|폐기)\s*[:：-]\s*", "")
    return F.struct(F.regexp_replace(code, r"\s", "").alias("code"), spaces(F.regexp_replace(rest, r"^\s*(?:[-–—•·*:：]\s*)+", "")).alias("text"))


def _singles(c: Column) -> Column:
    """s for a token with one Hangul syllable, m for another, joined."""
    tokens = F.filter(F.split(spaces(c), " "), lambda x: x != "")
    return F.array_join(F.transform(tokens, lambda x: F.when(F.length(F.regexp_replace(x, "[^가-힣]", "")) == 1, F.lit("s")).otherwise(F.lit("m"))), "")


def letter_spaced(c: Column) -> Column:
    """True for a text with a blank after nearly every syllable: six Hangul words or more, half of them single, four in a row."""
    words = F.size(F.filter(F.split(spaces(c), " "), lambda x: x.rlike("[가-힣]")))
    flags = _singles(c)
    return (words >= 6) & (F.length(F.regexp_replace(flags, "m", "")) * 2 >= words) & F.contains(flags, F.lit("ssss"))


def oddly_spaced(c: Column) -> Column:
    return F.contains(_singles(c), F.lit("sss"))


def run_together(c: Column) -> Column:
    """True for Hangul with hardly any blank: words of more than five syllables on average."""
    parts = F.filter(F.transform(F.split(spaces(c), " "), lambda x: F.regexp_replace(x, "[^가-힣]", "")), lambda x: x != "")
    letters = F.length(F.array_join(parts, ""))
    return (letters >= 6) & (letters > 5 * F.size(parts))


def closed_gaps(c: Column) -> Column:
    """A letter-spaced text with its single syllables joined; another text as it is."""
    joined = F.regexp_replace(spaces(c), r"(?<=(?:^|\s)[가-힣])\s(?=[가-힣](?:\s|[.,)]|$))", "")
    return F.when(letter_spaced(c), joined).otherwise(c)


def ends_sentence(c: Column) -> Column:
    """True where a Korean sentence can end: on a usual ending, on a syllable that closes with m, or on another script."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s.)]+$", "")
    last = F.right(v, F.lit(1))
    code = F.ascii(last) - 44032
    m = (code >= 0) & (code < 11172) & (code % 28 == 16) & ~v.rlike(f"(?:{'|'.join(M_NOUNS)})$")
    return (v == "") | m | v.rlike(f"(?:{'|'.join(ENDINGS)})$") | ~last.rlike("[가-힣]")


def contacts(c: Column) -> Column:
    """(phone, emergency) of a contact field whose parts may be labelled. A single number is the emergency one."""
    parts = F.filter(F.split(spaces(c), r"\s*[/|·]\s*"), lambda x: x != "")
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:：]{0,26}[:：]\s*", ""))
    urgent = lambda x: x.rlike("(?i)긴급|젂급|응급|emergency")
    first = lambda xs: F.coalesce(F.get(F.filter(F.transform(xs, value), lambda x: x != ""), F.lit(0)), F.lit(""))
    phone, emergency = first(F.filter(parts, lambda x: ~urgent(x))), first(F.filter(parts, urgent))
    return F.struct(F.when(emergency == "", "").otherwise(phone).alias("phone"), F.when(emergency == "", phone).otherwise(emergency).alias("emergency"))


def phone(c: Column) -> Column:
    """A Korean telephone number with dashes; '' for a text without one."""
    raw = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<![0-9-])(0[0-9]{1,2}[\s)\-.]{1,3}[0-9]{3,4}[\s\-.]{1,3}[0-9]{4})(?![0-9-])", 1)
    n = F.regexp_replace(raw, "[^0-9]", "")
    area = F.when(n.startswith("02"), 2).otherwise(3)
    return F.when(n == "", "").otherwise(F.concat_ws("-", n.substr(F.lit(1), area), n.substr(area + 1, F.length(n) - area - 4), F.right(n, F.lit(4))))


def amount(c: Column) -> Column:
    """A content as it is written, in one form: a range with ~, a bound with its sign, a percentage with its word; else ''."""
    v = spaces(c)
    span = F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)\s*[~\-–]\s*([0-9]+(?:\.[0-9]+)?)", 0)
    bound = F.regexp_extract(v, r"[<>≤≥]\s*[0-9]+(?:\.[0-9]+)?", 0)
    share = F.regexp_extract(v, r"(?<![0-9\-.])([0-9]+(?:\.[0-9]+)?)\s*%", 1)
    word = F.regexp_extract(v, "이상|이하", 0)
    return F.when(span != "", F.regexp_replace(span, r"\s*[~\-–]\s*", "~")).when(bound != "", F.regexp_replace(bound, r"\s", "")).when(share != "", F.concat(share, F.lit("%"), F.when(word != "", F.concat(F.lit(" "), word)).otherwise(""))).otherwise("")


def path_error(c: Column) -> Column:
    """What is wrong with a published path; null for a sound one."""
    v = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\\", "/")
    r = F.regexp_replace(v, "^/+", "")
    bad = v.rlike("^https?://") | ~r.startswith("pdf/") | r.rlike(r"(^|/)\.\.?(/|$)") | ~r.rlike(r"(?i)[^/]\.pdf$")
    return F.when(v == "", "PDF_PATH_MISSING").when(bad, "PDF_PATH_INVALID")


def html(c: Column) -> Column:
    return reduce(lambda a, b: F.replace(a, F.lit(b[0]), F.lit(b[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], F.coalesce(c, F.lit("")))


def flag_value(c: Column) -> Column:
    """○ for a stated flag, '' for a denied one, ? for another text, null for a blank."""
    v = spaces(c)
    return F.when(v == "", F.lit(None)).when(v.rlike("^[○Oo●ㅇ]|^해당(?!\\s*없음)|^대상"), "○").when(v.rlike("없음|아님|^[-×xX]"), "").otherwise("?")


def name_core(c: Column) -> Column:
    """A substance's name outside parentheses and before a slash, semicolon or comma, as letters only."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), r"[(（\[][^)）\]]*[)）\]]?", "")
    return keys.word_key(F.regexp_replace(v, r"[/;,].*$", ""))


def same_substance(a: Column, b: Column) -> Column:
    x, y = name_core(a), name_core(b)
    return F.coalesce((x != "") & ((x == y) | ((F.least(F.length(x), F.length(y)) >= 3) & (F.contains(x, y) | F.contains(y, x)))), F.lit(False))


def component_name(c: Column) -> Column:
    """A component's name without labels and bullets; '' for headers, numbers and placeholders."""
    v = spaces(F.regexp_replace(spaces(c), r"(?i)^(?:[-·•○]\s*)*(?:화학물질명|물질명|성분명|관용명|이명)\s*[:：]?\s*", ""))
    bad = v.rlike(r"(?i)^(?:cas\s*(?:no\.?|번호)?|함유량.*|자료\s*없음|해당\s*없음|[0-9.,%~<>\s-]*)$")
    return F.when(bad, F.lit("")).otherwise(v)


def clean_cas(c: Column) -> Column:
    """A number without blanks around its dashes."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*[-–—]\s*", "-")


def junk_name(c: Column) -> Column:
    """Why a component's name is no name: header, page, number, brackets, percent; null if it is one."""
    v = spaces(c)
    opened, closed = F.length(F.regexp_replace(v, "[^(（]", "")), F.length(F.regexp_replace(v, "[^)）]", ""))
    return (
        F.when(v == "", "blank").when(v.rlike(r"(?i)^(?:화학물질명|물질명|성분|cas|함유량|관용명)"), "header").when(v.rlike(r"(?i)page\s*[0-9]|[0-9]+\s*/\s*[0-9]+\s*(?:페이지|쪽)?$"), "page")
        .when(v.rlike(r"^[0-9.,\s-]+$"), "number").when(opened != closed, "brackets").when(v.rlike("[0-9]\\s*%"), "percent")
    )


def broken_font(c: Column) -> Column:
    """True for a text of 200 syllables or more of which every two-hundredth at least is one that only broken fonts give."""
    v = F.coalesce(c, F.lit(""))
    hangul, odd = F.length(F.regexp_replace(v, "[^가-힣]", "")), F.length(F.regexp_replace(v, "[^싞늒맊홖젂핚짂갂숚렦맋핛젗벖첛얶옦젘앆젃]", ""))
    return (hangul >= 200) & (odd / F.greatest(hangul, F.lit(1)) >= 0.005)


def plausible_supplier(c: Column) -> Column:
    v = spaces(c)
    return (F.length(v) <= 80) & ~v.rlike(r"(?i)^[-.:/]*$|자료\s*없음|^정보\s*:?$|유통업자\s*정보|공급자\s*/\s*유통업자\s*정보|권고\s*용도|보관하시오|safety\s+data\s+sheet|information")


def plausible_product(c: Column) -> Column:
    v = spaces(c)
    return (v != "") & (F.length(v) <= 90) & ~v.rlike(r"권고\s*용도|사용상의\s*제한|제품의\s*권고\s*용도")


def summarised(c: Column, most: int, between: str) -> Column:
    """The first items joined, and how many more there are."""
    kept = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    shown = F.slice(kept, 1, most)
    more = F.coalesce(F.size(c), F.lit(0)) - F.size(shown)
    return F.concat(F.array_join(shown, between), F.when((F.size(shown) > 0) & (more > 0), F.concat(F.lit(" 외 "), more.cast("string"), F.lit("건"))).otherwise(""))


def standard_file(supplier: Column, name: Column, date: Column) -> Column:
    """Company_Product_MSDS_date.pdf, without characters that file systems refuse."""
    safe = lambda c: F.regexp_replace(spaces(F.regexp_replace(c, r'[\\/:*?"<>|]', "-")), r"\.+$", "")
    who = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(supplier, F.lit("")), LEGAL, "")), r"\s+(?:본사|\S*공장)$", ""))
    who = F.when(who == "", "회사미상").otherwise(who)
    what = F.trim(F.coalesce(name, F.lit("")))
    what = F.when(F.lower(what).startswith(F.concat(F.lower(who), F.lit(" "))), F.trim(what.substr(F.length(who) + 2, F.length(what)))).otherwise(what)
    digits = F.regexp_replace(F.coalesce(date, F.lit("")), "[^0-9]", "")
    return F.concat(safe(who), F.lit("_"), safe(what), F.lit("_MSDS_"), F.when(F.length(digits) == 8, digits).otherwise("날짜없음"), F.lit(".pdf"))

