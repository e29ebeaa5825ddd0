"""Column functions on text: tokens, normal form, names, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries don't search for.
STOPWORDS = (
    "the", "and", "for", "are", "with", "from", "that", "this", "what", "when", "where", "which", "who", "whom", "whose",
    "why", "how", "did", "does", "do", "is", "was", "were", "be", "been", "being", "regarding", "discuss", "discussed", "about",
)
WORD = "[a-zA-Z0-9_]+"
SHARDS = 64


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cast_or(c: Column | str, kind: str, default: object) -> Column:
    """The value as another type, or ``default`` where it is null or can't be cast."""
    return F.coalesce(_c(c).try_cast(kind), F.lit(default).cast(kind))


def day(utc: Column | str) -> Column:
    """Date of epoch seconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(utc) / 86400).cast("int"))


def index_bag(text: Column | str) -> Column:
    """Words of at least three characters, lower case, repeated as they occur."""
    return F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0)), lambda x: F.length(x) >= 3)


def index_tokens(text: Column | str) -> Column:
    """The set that an index holds of a text (stop words included)."""
    return F.array_distinct(index_bag(text))


def token_bag(text: Column | str) -> Column:
    """As ``index_bag`` without stop words: what term frequencies count."""
    return F.filter(index_bag(text), lambda x: ~x.isin(*STOPWORDS))


def tokens(text: Column | str) -> Column:
    """The set of search words of a text or query."""
    return F.array_distinct(token_bag(text))


def diversity_tokens(text: Column | str) -> Column:
    """Words of plain Latin letters and digits only; those glued to other letters or underscores don't count."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: x.rlike("^[a-z0-9]+$")))


def normalize(text: Column | str) -> Column:
    """Line ends to LF, runs of blanks to one, three or more LF to two, no white space at the ends."""
    t = F.regexp_replace(_c(text), "\r\n|\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), r"\s+$", "")


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4).cast("int"))


def file_type(path: Column | str) -> Column:
    """Lower-case extension, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1)), F.lit(""))


def term_shard(term: Column | str, shards: int = SHARDS) -> Column:
    """First eight bytes of the hash, as a big-endian number, modulo ``shards`` (a power of two up to 256)."""
    return (F.conv(F.substring(F.sha2(_c(term), 256), 15, 2), 16, 10).cast("int") % shards).cast("int")


def safe_stem(query: Column | str, ranker: str) -> Column:
    words = F.regexp_replace(F.trim(F.regexp_replace(F.lower(_c(query)), r"\s+", " ")), " ", "_")
    return F.concat(F.substring(words, 1, 80), F.lit("." + ranker))


def safe_id(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "[^A-Za-z0-9._-]+", "_")


def chunk_id(path: Column | str, source_hash: Column | str, index: Column | str) -> Column:
    return F.format_string("%s::%s::%04d", _c(path), _c(source_hash), _c(index))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common elements; 0 if either set is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def is_maildir(path: Column | str) -> Column:
    """Whether a file without extension lies below a folder that mail stores use."""
    #: Names of mail folders.
    folders = ("maildir", "inbox", "sent", "sent_items", "_sent_mail", "deleted_items", "discussion_threads", "all_documents")
    p = F.lower(_c(path))
    parents = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(parents, F.array(*map(F.lit, folders))) & F.regexp_extract(p, "([^/]*)$", 1).rlike(r"^[^.]*$|^\.[^.]*$|\.$")
