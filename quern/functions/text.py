"""Text primitives as Column expressions: the five tokenizers, folding, stemming, sentences and sentence tests.

Most are native expressions, so a scan can push them down its whole-stage pipeline. Stemmed tokens and sentences go by Arrow columns: a token's
stem is looked up among a batch's distinct forms, and sentences are told by Arrow's own regular expressions, which need no look-around.
Word boundaries are those of ASCII words on purpose: Java's own are Unicode-aware and would find other matches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A boundary between an ASCII word character and another one.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# ---- fixed values -----------------------------------------------------------
PLAIN_STOP = ["nedir", "nasil", "ne", "mi", "mu", "ile", "icin", "ve", "veya", "bir", "bu", "the", "what", "is", "are", "how", "to", "a", "an", "of", "for", "and", "in", "on", "at", "by", "with", "about", "from"]
RANK_STOP = [
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by", "for", "with", "about", "is", "are", "was", "were", "be", "been", "it", "this", "that", "as", "from", "not", "no", "do", "does", "did", "can", "will", "would",
    "ve", "veya", "ile", "icin", "bir", "bu", "su", "o", "de", "da", "ki", "mi", "mu", "ama", "fakat", "gibi", "kadar", "daha", "cok", "az", "olan", "olarak",
]
TR_SUFFIXES = [
    "larindan", "lerinden", "larimiz", "lerimiz", "lariniz", "leriniz", "lardan", "lerden", "larin", "lerin", "lari", "leri", "lar", "ler", "imiz", "iniz", "umuz", "unuz", "sin", "sun", "dir", "dur", "tir", "tur",
    "nin", "nun", "in", "un", "im", "um", "ye", "ya", "de", "da", "te", "ta", "den", "dan", "ten", "tan", "le", "la", "ce", "ca", "si", "su", "i", "u", "e", "a",
]
EN_SUFFIXES = ["ational", "iveness", "fulness", "ousness", "ization", "ation", "ingly", "edly", "ies", "ied", "ing", "ers", "er", "est", "ed", "es", "s", "ly"]
NEWS_SUFFIX_MIN = 4
FACTUAL = [r"\d", r"\b(göre|bildirdi|açıkladı|duyurdu|oldu|olacak|arttı|azaldı|yüzde)\b", r"\b(according to|reported|announced|said|rose|fell|percent|study found|is the)\b"]
NOISE = [r"\b(çerez|cookie|abone ol|subscribe|newsletter|gizlilik politikası|privacy policy|tüm hakları)\b", r"\b(share this|read more|advertisement|sign in|log in)\b"]
NEGATION = r"\b(değil|yok|olmadı|reddetti|not|no longer|denied|false)\b"
QUESTION = [
    r"\?\s*$",
    r"^\s*(question|soru)\s*[:.]",
    r"^\s*(how|what|why|when|where|which|who|can|does|do|is|are|should|would|could|has|have)\b[^.!]*\?",
    r"^\s*(nasıl|neden|niçin|ne zaman|nerede|hangi|kim|mı|mi|mu|mü)\b[^.!]*\?",
    r"\b(any (idea|help|suggestions)|please help|i am trying to|i'm trying to|denedim ama)\b",
]
# -----------------------------------------------------------------------------


def matches(text: Column, patterns: str | list[str]) -> Column:
    """Whether any pattern matches, ignoring the case of ASCII letters; \\b is an ASCII boundary."""
    own = [patterns] if isinstance(patterns, str) else patterns
    return text.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in own).replace(r"\b", EDGE) + ")")


def normalize(text: Column) -> Column:
    """Lower case, Turkish and circumflex letters plain, other characters than a-z and 0-9 to single spaces."""
    plain = F.translate(F.lower(text), "çğıöşüâîû", "cgiosuaiu")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def plain_tokens(text: Column) -> Column:
    """T1: normalized words of three letters or more that aren't stop words; duplicates stay."""
    stop = F.array(*map(F.lit, PLAIN_STOP))
    return F.filter(F.split(normalize(text), " "), lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, x))


def accents() -> tuple[str, str]:
    """Letters with a canonical decomposition into a base letter and marks, and their bases, from the Unicode tables."""
    import unicodedata

    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]) and chr(i).lower() == chr(i):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = accents()


def fold(word: Column) -> Column:
    """Lower case without marks; dotless and dotted capital i are plain i's."""
    return F.regexp_replace(F.translate(F.lower(word), "ı" + _FROM, "i" + _TO), "[\\u0300-\\u036f]", "")


def _stem_of(x: Column) -> Column:
    """The stem of x.w, whose form without a Turkish suffix is x.tr."""
    w, tr = x["w"], x["tr"]
    en = F.regexp_replace(w, "(?:" + "|".join(EN_SUFFIXES) + ")$", "")
    whole = w.rlike("(?:ss|us|is)$") & ~w.rlike("(?:ies|ses|xes|zes|ches|shes)$")
    return (
        F.when(F.length(w) <= 4, w)
        .when((F.length(tr) >= 3) & (tr != w), tr)
        .when(whole, w)
        .when(w.rlike("[^aeiou]ie[sd]$"), F.regexp_replace(w, "ie[sd]$", "y"))
        .when(F.length(en) < 3, w)
        .otherwise(F.regexp_replace(en, r"([^aeiouls z])\1$", "$1"))
    )


def stems(words: Column) -> Column:
    """Folded words less a Turkish suffix, else their English plural or suffix; words of up to four letters stay.

    Each step is a pass over the array, so that its value is computed once a word and not once for each use.
    """
    tr = "(?:" + "|".join(TR_SUFFIXES) + ")$"
    pairs = F.transform(F.transform(words, fold), lambda w: F.struct(w.alias("w"), F.when(F.length(w) > 4, F.regexp_replace(w, tr, "")).otherwise(w).alias("tr")))
    return F.transform(pairs, _stem_of)


def stem(word: Column) -> Column:
    return stems(F.array(word))[0]


_PLAIN, _MARKS = str.maketrans("ı" + _FROM, "i" + _TO), re.compile("[\u0300-\u036f]")
_TR, _EN = (re.compile("(?:" + "|".join(x) + ")$") for x in (TR_SUFFIXES, EN_SUFFIXES))
_WHOLE, _PLURAL, _IES, _IE, _DOUBLE = map(re.compile, ("(?:ss|us|is)$", "(?:ies|ses|xes|zes|ches|shes)$", "[^aeiou]ie[sd]$", "ie[sd]$", r"([^aeiouls z])\1$"))


def stem_of(word: str) -> str:
    """What stem says, of one word in Python."""
    w = _MARKS.sub("", word.lower().translate(_PLAIN))
    if len(w) <= 4:
        return w
    tr = _TR.sub("", w)
    if len(tr) >= 3 and tr != w:
        return tr
    if _WHOLE.search(w) and not _PLURAL.search(w):
        return w
    if _IES.search(w):
        return _IE.sub("y", w)
    en = _EN.sub("", w)
    return w if len(en) < 3 else _DOUBLE.sub(r"\1", en)


def _term_of(form: str, stop=frozenset(RANK_STOP)) -> str | None:
    """The term that a word as written makes, if any."""
    own = form.strip("._-")
    if len(own) < 2:
        return None
    term = stem_of(own)
    return term if len(term) >= 2 and term not in stop else None


#: Forms whose terms a worker remembers.
KNOWN_FORMS = 500_000


def _terms():
    known: dict = {}

    def terms(raw: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        row = pc.list_parent_indices(raw).to_numpy(zero_copy_only=False)
        coded = raw.flatten().dictionary_encode()
        forms, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(known) > KNOWN_FORMS:
            known.clear()
        own = [known[x] if x in known else known.setdefault(x, _term_of(x)) for x in forms]
        stays = np.array([x is not None for x in own], dtype=bool)[code]
        values = pa.array(own, pa.string()).take(pa.array(code[stays]))
        ends = np.concatenate(([0], np.cumsum(np.bincount(row[stays].astype(np.int64), minlength=len(raw))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=raw.is_null() if raw.null_count else None)

    return terms


def rank_tokens(text: Column) -> Column:
    """T2: stemmed Unicode words that keep inner dots, hyphens and underscores, of two letters or more, without stop words."""
    raw = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}_.-]*"), F.lit(0))
    return F.arrow_udf(_terms(), "array<string>")(raw)


def gate_tokens(text: Column) -> Column:
    """T3: lower-cased words of four letters or more, less their last two letters but four at least."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) >= 4), lambda x: F.substring(x, F.lit(1), F.greatest(F.lit(4), F.length(x) - 2)))


def short_tokens(text: Column) -> Column:
    """T4: lower-cased words of three letters or more."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) >= 3)


def any_of(patterns: list[str]) -> str:
    """One pattern for several, in the syntax of RE2, whose \\b is an ASCII boundary."""
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def _told(text: pa.Array) -> pa.Array:
    import numpy as np
    import pyarrow.compute as pc

    # A line feed parts sentences as it parts lines.
    parted = pc.replace_substring_regex(text, r"""([.!?…])\s+([A-ZÇĞİÖŞÜ0-9"'])""", "\\1\n\\2")
    parts = pc.split_pattern(parted, "\n")
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    own = parts.flatten()
    fits = pc.greater_equal(pc.utf8_length(own), 45)
    own, row = own.filter(fits), row[fits.to_numpy(zero_copy_only=False)]
    own = pc.utf8_trim(pc.replace_substring_regex(own, r"\s+", " "), " ")
    n = pc.utf8_length(own)
    fits = pc.and_(pc.greater_equal(n, 45), pc.less_equal(n, 400))
    own, row = own.filter(fits), row[fits.to_numpy(zero_copy_only=False)]
    fits = pc.invert(pc.or_(pc.match_substring_regex(own, any_of(NOISE)), pc.match_substring_regex(own, any_of(QUESTION))))
    own, row = own.filter(fits), row[fits.to_numpy(zero_copy_only=False)]
    told = pa.StructArray.from_arrays([own, pc.match_substring_regex(own, any_of(FACTUAL))], names=["s", "factual"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(text))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), told, mask=text.is_null() if text.null_count else None)


def told_sentences(text: Column) -> Column:
    """Sentences (s, factual) that a claim may come from: 45 to 400 characters, neither boilerplate nor questions."""
    return F.arrow_udf(_told, "array<struct<s:string,factual:boolean>>")(text)


def sentences(text: Column) -> Column:
    """The texts of told_sentences."""
    return F.transform(told_sentences(text), lambda x: x["s"])


def is_question(sentence: Column) -> Column:
    return matches(sentence, QUESTION)


def is_factual(sentence: Column) -> Column:
    return matches(sentence, FACTUAL)


def negates(sentence: Column) -> Column:
    return matches(sentence, NEGATION)


def numbers(sentence: Column) -> Column:
    """Runs of digits of the normalized sentence: points and commas part them."""
    return F.regexp_extract_all(normalize(sentence), F.lit(r"\d+"), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Common members over the smaller set's size; 0 where either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def passage_sentences(text: Column) -> Column:
    """Sentences or lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?…])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
