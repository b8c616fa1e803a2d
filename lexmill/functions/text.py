"""Text normalisation and extraction as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Word characters of any script, for patterns that both engines read alike.
WORD = r"[\p{L}\p{N}_]+"


def _bare(char: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
    return {"đ": "d", "Đ": "D"}.get(char, plain)


#: Precomposed Latin letters and their bare forms, built by decomposition.
ACCENTED = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(_bare(chr(c))) == 1 and _bare(chr(c)) != chr(c)]
ACCENTS, BARE = "".join(ACCENTED), "".join(map(_bare, ACCENTED))


def fold(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Replacements one after the other; patterns are case-sensitive unless they say otherwise."""
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip_accents(text: Column) -> Column:
    """Letters without their accents, one for one, so that positions stay."""
    return F.translate(text, ACCENTS, BARE)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; there is no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def tokenize(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def squeeze(text: Column) -> Column:
    """Single spaces, none before punctuation, straight quotes, no space at the ends."""
    plain = fold(text, [(r"\s+", " "), (r"\s+([.,;:!?])", "$1")])
    return F.trim(F.translate(plain, "“”‘’", "\"\"''"))


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def squeeze_lines(text: Column) -> Column:
    """Single spaces within each line, none at a line's ends."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), "\n")


def slugify(text: Column) -> Column:
    """An ASCII slug; "pháp luật về X" counts as "luật X"; "unknown" if nothing is left."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?iu)pháp\s+luật\s+về\s+", "luật ")
    slug = F.regexp_replace(F.lower(strip_accents(plain)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(slug, "^_+|_+$", "")), F.lit("")), F.lit("unknown"))


def safe_filename(name: Column) -> Column:
    """A file name without reserved characters and Vietnamese letters, single underscores."""
    plain = strip_accents(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"))
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_+|_+$", "")


# The boilerplate of legal documents.
_PAGE_LINES = [(r"\n\s*[-']*\s*\d{1,3}\s*\n", "\n"), (r"(?m)^\s*\d{1,3}\s*$", ""), (r"\n\s*[-_]{3,}\s*\n", "\n")]
_SIGNATURE = r"(?isu)Chủ\s+tịch\s+Quốc\s+hội.*"


def clean_document(text: Column) -> Column:
    """Raw document text without page numbers, rules, the signature block and loose spacing.

    Input is expected composed (``nfc``) and, where a scan lost its spaces, split.
    """
    joined = F.regexp_replace(text, r"([A-ZĐ])-\s+([A-ZĐ])", "$1-$2")
    body = F.regexp_replace(fold(joined, _PAGE_LINES), _SIGNATURE, "")
    return F.regexp_replace(fold(body, [(" {3,}", "  "), ("\n{3,}", "\n\n"), (r"\s+([,;:.])", "$1")]), r"^\s+|\s+$", "")


def clean_content(text: Column) -> Column:
    """A node's text, cut at the list of recipients and at a form's head, on one line."""
    # most texts have none of this, which is seen without a search by pattern
    cut = F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, r"(?isu)[ \n\t,./]*Nơi\s+nhận\s*:.*", "")).otherwise(text)
    form = F.contains(cut, F.lit("HỘ,")) | F.contains(cut, F.lit("SỔ"))
    cut = F.when(form, F.regexp_replace(cut, r"(?s)[ \n\t,.:]*(?:HỘ,\s*CÁ\s+NHÂN\s+KINH|SỔ\s+DOANH\s+THU\s+BÁN\s+HÀNG).*", "")).otherwise(cut)
    loose = F.contains(cut, F.lit("\n")) | F.contains(cut, F.lit("  "))
    return F.trim(F.when(loose, F.regexp_replace(cut, "\n| {2,}", " ")).otherwise(cut))


# Misreadings of scanned pages and what they stand for, in order.
OCR_FIXES = [
    (r"(?m)^[/\\§$#@!*{}\[\]|~^<>]{1,}[^\n]{0,60}?(Phụ\s+lục)", "\n$1"),
    (r"(?U)\bl\b(?=\s*\d)", "1"),
    (r"(?<=\d)O(?=\d)", "0"),
    ("Ðiều", "Điều"),
    ("Khoán", "Khoản"),
    ("Diéu", "Điều"),
    (r"thuê\s+suât", "thuế suất"),
    (r"thuê\s+suất", "thuế suất"),
    (r"Chinh\s+phủ", "Chính phủ"),
    (r"câ\s+nhân", "cá nhân"),
    (r"thu\s+nhâp", "thu nhập"),
    (r"\s+([,;:.])", "$1"),
    (r"\n{3,}", "\n\n"),
    (r"Chương\s+IH\b", "Chương III"),
    (r"Chương\s+HI\b", "Chương III"),
    (r"Chương\s+TV\b", "Chương IV"),
    (r"Chương\s+VI1\b", "Chương VII"),
    (r"Chương\s+VI11\b", "Chương VIII"),
    (r"Chương\s+1X\b", "Chương IX"),
    (r"Chương\s+1\b", "Chương I"),
    (r"Mục\s+IH\b", "Mục III"),
    (r"Mục\s+HI\b", "Mục III"),
    (r"Mục\s+TV\b", "Mục IV"),
]


def fix_ocr(text: Column) -> Column:
    return fold(text, OCR_FIXES)


# Ends of a law's name, on text without accents.
_NAME_TAIL = r"(?iu)\s+và\s+(?:các\s+)?(?:văn\s+bản|quy\s+định)(?:\s+\S+)*"
_NAME_STOP = r"(?i)(?:\s+(?:trong|theo|ve\s+viec|doi\s+voi|nham\s+muc|duoc\s+ap)\b|,\s+(?:mua|ban|ky|cap|thi\s+hanh|nham|hoac\s+la|nghi\s+quyet|van\s+ban|quyet\s+dinh|giai\s+phap|quy\s+dinh|huong\s+dan)\b)"


def clean_law_name(name: Column) -> Column:
    """The name of a law, cut where a clause begins; the cut is found without accents and made in the original."""
    short = F.regexp_replace(name, _NAME_TAIL, "")
    at = F.regexp_instr(strip_accents(short), F.lit(_NAME_STOP))
    return F.trim(F.regexp_replace(F.when(at > 0, F.substring(short, F.lit(1), at - 1)).otherwise(short), "[ ,]+$", ""))


# Abbreviations that a keyword query is widened by, those that answers are compared by, and phrases of one legal meaning.
SYNONYMS = {
    "gtgt": "giá trị gia tăng",
    "tncn": "thu nhập cá nhân",
    "hkd": "hộ kinh doanh",
    "bđs": "bất động sản",
    "tmđt": "thương mại điện tử",
    "bhxh": "bảo hiểm xã hội",
    "bhyt": "bảo hiểm y tế",
    "bhtn": "bảo hiểm thất nghiệp",
    "nđ": "nghị định",
    "tt": "thông tư",
    "qh": "quốc hội",
    "ubnd": "ủy ban nhân dân",
    "hđkt": "hóa đơn kế toán",
    "vat": "giá trị gia tăng",
    "pit": "thu nhập cá nhân",
}
ABBREVIATIONS = {
    "tncn": "thu nhập cá nhân",
    "gtgt": "giá trị gia tăng",
    "hkd": "hộ kinh doanh",
    "ckd": "cá nhân kinh doanh",
    "tmđt": "thương mại điện tử",
    "cccd": "căn cước công dân",
    "cmnd": "căn cước công dân",
    "cty": "công ty",
    "nđ-cp": "nghị định",
    "tt-btc": "thông tư",
    "tt-btp": "thông tư",
    "ubnd": "ủy ban nhân dân",
    "mst": "mã số thuế",
    "hđlđ": "hợp đồng lao động",
    "bctc": "báo cáo tài chính",
}
PARAPHRASES = [
    (r"không\s+phải\s+chịu\s+thuế", "không chịu thuế"),
    (r"thuộc\s+diện\s+không\s+chịu\s+thuế", "không chịu thuế"),
    (r"không\s+thuộc\s+diện\s+chịu\s+thuế", "không chịu thuế"),
    (r"không\s+cần\s+phải\s+", "không phải "),
    (r"không\s+cần\s+", "không phải "),
    (r"không\s+bắt\s+buộc\s+phải\s+", "không phải "),
    (r"không\s+bắt\s+buộc\s+", "không phải "),
    (r"hoàn\s+toàn\s+có\s+thể\s+", "được phép "),
    (r"có\s+quyền\s+", "được phép "),
    (r"(?U)(?:^|(?<=\s))có\s+thể\s+(?!bị\b)", "được phép "),
    (r"có\s+thể\s+bị\s+", "bị "),
    (r"vẫn\s+có\s+thể\s+bị\s+", "vẫn bị "),
    (r"vẫn\s+phải\s+", "vẫn "),
]


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def expand_synonyms(query: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The query with the long form of each abbreviation that it does not hold already, in token order."""
    full = F.transform(tokenize(query), lambda t: F.try_element_at(literal_map(synonyms), t))
    more = F.filter(full, lambda x: x.isNotNull() & ~F.contains(F.lower(query), x))
    return F.when(F.size(more) > 0, F.concat_ws(" ", query, F.array_join(more, " "))).otherwise(query)


def expand_abbreviations(text: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Lower-case text with abbreviations, as whole words, written out."""
    return fold(F.lower(text), [(rf"(?U)(?<!\w){re.escape(k)}(?!\w)", v) for k, v in table.items()])


def plain_paraphrase(text: Column) -> Column:
    """Lower-case text with phrases of the same legal meaning written alike."""
    return fold(F.lower(text), PARAPHRASES)


def strip_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"\*+|__+", "")


def for_search(text: Column) -> Column:
    """Lower case, punctuation and curly quotes as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def citations(answer: Column) -> Column:
    """Distinct "article|document" citations in order of first appearance."""
    pattern = r"(?iu)điều\s+(\d+[a-z]?)[^.\n]{0,120}?(\d{1,4}/\d{4}/[A-ZĐ][A-ZĐ0-9\-]*)"
    article = F.regexp_extract_all(answer, F.lit(pattern), F.lit(1))
    document = F.regexp_extract_all(answer, F.lit(pattern), F.lit(2))
    return F.array_distinct(F.transform(F.arrays_zip(article.alias("a"), document.alias("d")), lambda x: F.concat_ws("#", x["d"], x["a"])))


def numbered_citations(answers: DataFrame, answer_id: str = "answer_id", answer: str = "answer") -> DataFrame:
    """Each answer's citations, numbered from 1 in order of first appearance: (answer_id, number, document, article)."""
    each = answers.select(answer_id, F.posexplode(citations(F.col(answer))).alias("pos", "c"))
    parts = F.split("c", "#")
    return each.select(answer_id, (F.col("pos") + 1).alias("number"), F.get(parts, F.lit(0)).alias("document"), F.get(parts, F.lit(1)).alias("article"))


# The parts of a Vietnamese syllable.
_INITIALS = "ngh ch gh gi kh ng nh ph qu th tr b c d đ g h k l m n p r s t v x".split()
_FINALS = ("ng", "nh", "ch", "c", "m", "n", "p", "t", "")
_VOWELS = set("aeiouy")


def _syllable_end(word: str, at: int) -> bool:
    """True if a syllable can end before ``at`` and another begin there."""
    bare = "".join(_bare(c) if c not in "đĐ" else "d" for c in word.lower())
    head, tail = bare[:at], bare[at:]
    if not head or not tail:
        return False
    nucleus = next((f for f in _FINALS if head.endswith(f) and len(head) > len(f) and head[len(head) - len(f) - 1] in _VOWELS), None)
    onset = next((i for i in _INITIALS if word.lower()[at:].startswith(i) and len(tail) > len(i) and tail[len(i)] in _VOWELS), None)
    return nucleus is not None and onset is not None and sum(c in _VOWELS for c in head) <= 3


def split_merged_word(word: str) -> list[str]:
    """Syllables of a word whose spaces a scan lost: cut at the leftmost boundary, then the rest."""
    out = []
    while len(word) > 5 and not re.search(r"[\d/]", word):
        at = next((i for i in range(2, len(word) - 1) if _syllable_end(word, i) and len(word) - i >= 2), None)
        if at is None:
            break
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


@F.pandas_udf(StringType())
def fix_merged_words(text: pd.Series) -> pd.Series:
    """Text with merged syllables set apart; words of up to five letters, with digits or slashes stay."""
    return text.map(lambda t: None if t is None else re.sub(r"\w[\w/]*", lambda m: " ".join(split_merged_word(m.group(0))), t))


@F.pandas_udf(ArrayType(StringType()))
def syllables(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else split_merged_word(w))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two strings' character sets: 1 if equal, 0 if one is empty."""
    x, y = F.array_distinct(F.split(F.lower(a), "")), F.array_distinct(F.split(F.lower(b), ""))
    both, one = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(both / one)
