"""Keys, terms, tokens and similarities of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that similarity leaves out.
COLORS_AND_EQUIPMENT = [  # fixed values
    "black", "dark", "white", "red", "pink", "brown", "blue", "green", "yellow", "turquoise", "lilac", "orange",
    "longboard", "shortboard", "board", "wetsuit", "bikini", "shirt", "swimsuit", "trunks", "shorts",
]
STOPWORDS = ["and", "the", "with", "for", "from", "player", "athlete", "person", "surfer", "wearing"]


def key(text: Column, joint: str = "_") -> Column:
    """Lower-cased, runs of other than a-z and 0-9 replaced by `joint`, none at the ends."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint)
    return F.regexp_replace(joined, f"^{joint}+|{joint}+$", "") if joint else joined


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unfenced(raw: Column) -> Column:
    """A reply without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def has_any(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t.lower()))
    return out


def labels(text: Column, terms: dict[str, list[str]]) -> Column:
    """The labels of which any term is in the text, in the dictionary's order."""
    return F.array_compact(F.array(*(F.when(has_any(text, t), F.lit(k)) for k, t in terms.items())))


def numbers(text: Column) -> Column:
    """Numbers on shirts: #7, bib 7, player 7, as a sorted set."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hashed = F.regexp_extract_all(low, F.lit(r"#\s*([0-9]{1,3})"), F.lit(1))
    named = F.regexp_extract_all(low, F.lit(r"\b(?:bib|player|jersey|number|no)\s*#?\s*([0-9]{1,3})\b"), F.lit(1))
    return F.array_sort(F.array_union(hashed, named))


def shirt_numbers(text: Column) -> Column:
    """Numbers of one to three digits that a description gives by #, number, no., bib, jersey or player, as a sorted set."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marked = F.regexp_extract_all(low, F.lit(r"(?:#|number\s+|no\.\s*|bib\s+|jersey\s+)([0-9]{1,3})"), F.lit(1))  # fixed patterns
    named = F.regexp_extract_all(low, F.lit(r"\bplayer\s+([0-9]{1,3})\b"), F.lit(1))
    return F.array_sort(F.array_union(marked, named))


def described(text: Column) -> Column:
    """A description as a key: lower-cased, only letters a-z, digits and inner blanks left."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", ""))


def tokens(text: Column, least: int = 3, stopwords: list[str] | None = None) -> Column:
    """Distinct tokens of at least `least` characters, without stop words, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in (STOPWORDS if stopwords is None else stopwords)))
    return F.array_sort(F.array_except(F.filter(found, lambda t: F.length(t) >= least), stop.cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(n.cast("double") / F.size(F.array_union(a, b)))


def prefix_similarity(a: Column, b: Column) -> Column:
    """1 less the share cut off where one text begins with the other, else 0."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    begins = F.startswith(a, b) | F.startswith(b, a)
    return F.when(begins & (short > 0), short.cast("double") / long).otherwise(F.lit(0.0))


def short_digest(*parts: Column, length: int = 16) -> Column:
    """The first digits of a SHA-1 over the parts, nulls as empty."""
    joined = F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha1(joined.cast("binary")), 1, length)


def athlete_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), 1, 16)


def batch_id(raw: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, 80)


def first_truthy(*cols: Column) -> Column:
    """The first text that isn't null or blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in cols))


def vocabulary_overlap(a: Column, b: Column, vocabulary: list[str]) -> Column:
    """The tokens of a vocabulary that both sets have, sorted."""
    known = F.array(*(F.lit(w) for w in vocabulary)).cast("array<string>")
    return F.array_sort(F.array_intersect(F.array_intersect(a, b), known))


def draft_label(name: Column) -> Column:
    """A draft's name without its DRAFT prefix and its date or part suffix."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^\s*draft[\s_:-]*", ""), r"(?i)[\s_-]*((\d{4}-?\d{2}-?\d{2})|(part[\s_-]*\d+)|(_\d{2}))\s*$", ""))


def _ascii(c: Column) -> Column:
    """A text with characters beyond ASCII as JSON escapes, those beyond 16 bits as two."""
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(x: Column) -> Column:
        code = F.ascii(x)
        above = code - 0x10000
        pair = F.concat(four(F.lit(0xD800) + F.shiftright(above, 10)), four(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return F.when(code < 128, x).when(code < 0x10000, four(code)).otherwise(pair)

    told = lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(t, ""), escaped), "")).otherwise(t)
    return F.get(F.transform(F.array(c), told), F.lit(0))  # so the text is made once, not in each branch


def canonical_json(raw: Column) -> Column:
    """JSON text with the keys of every object sorted, no blanks between, and only ASCII; null for what isn't JSON. It goes through a VARIANT, so numbers are
    written in one way too (1.50 as 1.5)."""
    return _ascii(F.to_json(F.try_parse_json(raw)))


def cleaned_json(value: Column) -> Column:
    """Any struct, array or map with text keys as canonical JSON: what JSON has no kind for (dates, time stamps, bytes) becomes text, nested as deep as it may be."""
    return _ascii(F.to_json(F.to_variant_object(value)))


def json_digest(raw: Column, length: int = 16) -> Column:
    """The first digits of a SHA-1 over JSON text that tells nothing of key order, letter case or blanks; what isn't JSON is digested as a text."""
    told = F.coalesce(canonical_json(raw), raw)
    plain = F.regexp_replace(F.trim(F.lower(told)), r"\s+", " ")
    return F.substring(F.sha1(plain.cast("binary")), 1, length)
