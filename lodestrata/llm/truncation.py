r"""Texts that lack their end, and how often each source cuts them off.

Method:

1. *Lengths.* One pass over the distinct texts gives the length of each under alternative storage forms (code points,
   UTF-8 bytes, UTF-16 units, entity or JSON escaping, other line ends), its ending, and the pairs of neighbouring words
   with how many of them end a sentence.
2. *Endings.* A text whose end has no stop is complete if its last two words end a sentence in most places where the
   corpus has them (in more than one of twenty, if an ellipsis follows the last word, as that may be its stop) and don't
   stand in an open bracket, or with a list item, link, table row, name or closing line; else it looks cut. What was put
   after a cut (dots, ``<cut>``, notes of the transfer) is taken off first, and its dots are no proof that the words before
   them end a sentence: of a large corpus' cuts many stop at the same letters.
3. *Hidden limits.* Distinct texts are counted by source, form and length. A limit is a length, anywhere in the
   histogram, that has far more texts than the lengths around it and most of whose texts look cut. A text that lies on
   several such spikes counts for the strongest; spikes that are left with few are the shadow of another form's limit.
4. At a limit of its source only a full stop (or a closing mark after one) makes a text complete; elsewhere what looks cut
   is.

Scale: texts are shuffled once, to take copies together; everything after that is narrow (hashes, lengths, endings of at
most ``END_CHARS``), is aggregated partially before each shuffle, and is joined on equal keys. Nothing is collected and no
broadcast is forced.

Defined results: null, empty and blank texts are complete; a null source forms a group of its own, for which the limits
of all sources count; repeated rows count once by document id in ``truncated``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import code_points, letters, materialise, mix64, powers

#: What transfers and exports put after a cut.
MARKS = r"(?:\s|\.\.\.|…|\[…\]|\[\.\.\.\]|�|=|<[A-Za-z][^<>\n]{0,24}>|\[[^\[\]\n]{3,40}\]|-{2,}[ \t]*[^\n]{3,40}?[ \t]*-{2,}|\(\.\.\.\)|>>+)+$"
#: Lines that printing or scanning adds below a text, complete or not.
FOOTERS = r"(?i)\s*\n[ \t]*(?:(?:page|seite|página|pagina)\s+\d+\s*(?:of|von|de|sur|/)\s*\d+|-\s*\d+\s*-)\s*$"
STOP = r"[.!?。！？][\"'”’»)\]]*$"
#: Code points that the inspection of an ending looks at, counted from the last that isn't white space.
END_CHARS = 800
EMOJI = "[\U0001f300-\U0001faff\u2600-\u27bf]\\s*$"


_PART = r"(?:\p{Lu}[\p{L}\p{M}'’.-]*|v[ao]n|de[rnl]?|la|da|di|y|el)"
NAME = _PART + r"(?:[ \t]+" + _PART + r")*"


#: The storage forms in which lengths are counted; those in bytes may fall short of a limit by part of a character.
FORMS = ("code_points", "utf8", "utf16", "entities", "entities_utf8", "json", "json_utf8", "json_ascii", "crlf", "crlf_utf8", "lf", "lf_utf8")
SLACK = 3
_SPACES = " \t\n\x0b\f\r\x85\xa0"
_AT_ONCE = 1 << 20  # code points


def stored_lengths(texts: list[str]) -> np.ndarray:
    """A row for each text, none of them empty, with its length under each of ``FORMS``."""
    a = code_points("".join(texts))
    starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
    count = lambda m: np.add.reduceat(m, starts, dtype=np.int32)
    chars = np.diff([*starts, len(a)]).astype(np.int32)
    feed = a == 10
    pair = np.concatenate(([False], feed[1:] & (a[:-1] == 13)))
    pair[starts] = False
    wide, astral = count(a >= 0x80), count(a >= 0x10000)
    octets = chars + wide + count(a >= 0x800) + astral
    feeds, pairs = count(feed), count(pair)
    quote = a == 34
    entities = 4 * count(a == 38) + 3 * count((a == 60) | (a == 62)) + 5 * count(quote | (a == 39))
    escapes = feeds + count(quote | (a == 92) | (a == 13) | (a == 9))
    return np.stack([
        chars, octets, chars + astral, chars + entities, octets + entities, chars + escapes, octets + escapes,
        chars + escapes + 5 * wide + 6 * astral, chars + feeds - pairs, octets + feeds - pairs, chars - pairs, octets - pairs,
    ], axis=1)


def _sets(chars: str) -> np.ndarray:
    m = np.zeros(0x110000, bool)
    m[[ord(c) for c in chars]] = True
    return m


_STOPS, _CLOSERS, _LEFT_OUT = ".!?。！？", "\"'”’»)]", "()[]\"'“”„«»’,;:.!?。！？…"
_tables: list[np.ndarray] = []


def word_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbouring words, the text of each, and whether it ends a sentence.

    Words are in lower case, without brackets, quotes and stops; words with as many digits are one. Two dots or more are no
    stop, as they are also put after a cut, nor is the dot after a single letter.
    """
    if not _tables:
        _tables.extend((_sets(" \t\n\x0b\x0c\r\x85\xa0\u2007\u202f\u3000"), _sets(_STOPS), _sets(_CLOSERS), _sets(_LEFT_OUT)))
    space, stop, closer, left_out = _tables
    _, lower, digit = letters()
    a = code_points("\n".join(texts))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    solid = ~space[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    at = np.flatnonzero(solid & ~closer[a])
    k = np.searchsorted(at, last) - 1
    end = at[np.maximum(k, 0)] if len(at) else np.zeros(len(last), np.int64)
    dots = (a[end] == 46) & (end > first) & (a[end - 1] == 46) if len(at) else np.zeros(len(last), bool)
    ends = (k >= 0) & (end >= first) & stop[a[end]] & ~dots if len(at) else np.zeros(len(last), bool)
    kept = np.flatnonzero(solid & ~left_out[a])
    up, down = powers(max(_AT_ONCE, 1 << (len(kept) + 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower[a[kept]] + np.uint32(1)).astype(np.uint64) * up[: len(kept)])))
    lo, hi = np.searchsorted(kept, first), np.searchsorted(kept, last)
    numbers = np.concatenate(([0], np.cumsum(digit[a[kept]])))
    digits = numbers[hi] - numbers[lo]
    words = np.where(digits > 0, digits.astype(np.uint64), mix64((sums[hi] - sums[lo]) * down[lo]))
    some = hi > lo
    ends &= (hi - lo != 1) | (digits > 0)
    ends_after = ends.copy()  # a stop of its own ends the word before
    ends_after[:-1] |= ends[1:] & ~some[1:]
    words, ends, of = words[some], ends_after[some], (np.searchsorted(starts, first, side="right") - 1)[some]
    before = np.where(digits[some] > 0, np.uint64(1), words)[:-1]  # how many digits counts for the second word only
    two = mix64(before * np.uint64(0xBF58476D1CE4E5B9) + words[1:])
    same = of[:-1] == of[1:]
    return two[same], of[1:][same], ends[1:][same]


def measured(texts: DataFrame) -> DataFrame:
    """(h, lengths, ending, pair, n, n_all) of distinct texts (h, text), none of them empty. The word pairs of a batch, how
    often they end a sentence and how often they stand elsewhere but at the end of a text, are in its first row."""

    def part(h: pa.Array, texts: list[str]) -> pa.RecordBatch:
        two, of, ends = word_pairs(texts)
        final = np.concatenate((of[1:] != of[:-1], [True])) if len(of) else np.zeros(0, bool)
        counts = ends | ~final
        pair, inverse = np.unique(two[counts], return_inverse=True)
        n = np.bincount(inverse, ends[counts], len(pair)).astype(np.int32)
        first = np.concatenate(([0], np.full(len(texts), len(pair)))).astype(np.int32)
        of_batch = lambda x, kind: pa.ListArray.from_arrays(pa.array(first), pa.array(x, kind))
        lengths = stored_lengths(texts)
        columns = [
            h, pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FORMS)), pa.array(lengths.ravel().astype(np.int32))), pa.array([t.rstrip(_SPACES)[-END_CHARS:] for t in texts], pa.string()),
            of_batch(pair.view(np.int64), pa.int64()), of_batch(n, pa.int32()), of_batch(np.bincount(inverse, minlength=len(pair)).astype(np.int32), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["h", "lengths", "ending", "pair", "n", "n_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= _AT_ONCE or i + 1 == len(texts):
                    yield part(b.column(0)[lo : i + 1], texts[lo : i + 1])
                    lo, size = i + 1, 0

    return texts.select("h", "text").mapInArrow(run, "h long, lengths array<int>, ending string, pair array<long>, n array<int>, n_all array<int>")


def sentence_ends(m: DataFrame) -> DataFrame:
    """(pair, n, n_all): how often each pair of words of the measured texts ends a sentence, and how often it stands anywhere
    but at the open end of a text."""
    z = m.where(F.size("pair") > 0).select(F.explode(F.arrays_zip("pair", "n", "n_all")).alias("z"))
    return z.groupBy("z.pair").agg(F.sum("z.n").alias("n"), F.sum("z.n_all").alias("n_all"))


@functools.cache
def _patterns():
    import regex

    return tuple(regex.compile(p) for p in (FOOTERS, "(?r)" + MARKS, STOP, EMOJI))


def without_marks(ending: str) -> tuple[str, bool, bool, bool]:
    """An ending without footers and what was added after a cut, whether something was, whether it has a stop, and whether
    what was added is an ellipsis right after a word, which may also be how the sentence ends."""
    footers, marks, stop, emoji = _patterns()
    t = footers.sub("", ending).rstrip()
    body = marks.sub("", t)
    return body, body != t, bool(stop.search(body[-40:])) or (body == t and bool(emoji.search(ending[-8:]))), t[len(body) :] in ("...", "…")


def open_endings(m: DataFrame) -> DataFrame:
    """(h, lengths, body, marked, dots, pair) of the measured texts (h, lengths, ending) that end without a stop; ``dots`` tells
    of an ellipsis, ``pair`` is that of the last two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [without_marks(t) for t in b.column(2).to_pylist()]
            at = [i for i, (body, _, stopped, _) in enumerate(ends) if not stopped and body.strip()]
            bodies = [ends[i][0] for i in at]
            two, of, _ = word_pairs(bodies) if at else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
            last = np.zeros(len(at), np.uint64)
            last[of] = two  # the last one stays
            k = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), pa.array(bodies, pa.string()), *(pa.array([ends[i][c] for i in at], pa.bool_()) for c in (1, 3)), pa.array(last.view(np.int64))], ["h", "lengths", "body", "marked", "dots", "pair"])

    return m.where(~_plain(F.col("ending"))).select("h", "lengths", "ending").mapInArrow(run, "h long, lengths array<int>, body string, marked boolean, dots boolean, pair long")


def closings(e: DataFrame) -> DataFrame:
    """Adds to open endings ``closing``, whether ``body`` ends with a list item, link, table row, name or closing line, and
    ``bracket``, whether it ends within a bracket."""
    d = e.withColumn("lines", F.filter(F.split("body", r"\r?\n"), lambda x: x.rlike(r"\S")))
    d = d.withColumn("last", F.trim(F.regexp_replace(F.coalesce(F.get("lines", F.size("lines") - 1), F.lit("")), r"^[>|\s]+", "")))
    d = d.withColumn("above", F.trim(F.coalesce(F.get("lines", F.size("lines") - 2), F.lit("")))).drop("lines")
    line = F.col("last")
    words = F.size(F.split(line, r"\s+"))
    name = line.rlike("^" + NAME + "$") & (words <= 5) & (F.length(line) >= 2)
    signed = name & (F.col("above").rlike(r",$|^[-_—–~=*#]{1,}\s*$") | (F.length("above") <= 34) & (F.size(F.split("above", r"\s+")) <= 5))
    titled = F.col("body").rlike(r"(?:^|\n)[ \t]*\r?\n" + NAME + r"[ \t]*\r?\n\p{Lu}[^\n.!?]{1,45}$") & (words <= 5)
    closing = (
        line.rlike(r"^(?:[-*•·–]|\d+[.)]|[a-z][.)])\s+\S")
        | line.rlike(r"(?i)(?:https?://|www\.)\S+$")
        | line.rlike(r"\|")
        | line.rlike(r"(?i)\S+@\S+\.\S+$")
        | line.rlike(r"(?i)^(?:cc|bcc|cci|kopie|copie|copia|anlagen?|encl\w*|attachments?|pi[eè]ces? jointes?|tel|phone|fax|m|t)\b\s*[:.]")
        | line.rlike(r"^\d+ \p{L}+$")
        | line.rlike(r"^[\p{Punct}\s]*$")
        | line.rlike(r"^\p{Lu}{2,}[\p{Lu}\s]*$")
        | line.rlike(r"(?i)^(?:sent from|envoyé|enviado|gesendet|get the)\b")
        | line.rlike(r"(?i)^\W*(?:n/?a|null|none|nil|tbd|todo|x+|test|-+)\W*$")
        | signed
        | titled
        | line.rlike(r",$") & (words <= 5)
    )
    d = d.withColumn("closing", F.coalesce(closing, F.lit(False)))
    return d.withColumn("bracket", F.right("body", F.lit(120)).rlike(r"\([^()\n|]{2,}$"))


class Corpus:
    """What ``docs`` (doc_id, source, text) tell about their texts' ends; all tables are in the shared folder.

    ``rows`` (doc_id, source, h) are the documents with a text, ``open`` (h, marked, looks_cut, lengths) the distinct
    texts that end without a stop, ``limits`` (source, form, cap, n_at) the storage limits.
    """

    def __init__(self, docs: DataFrame, ends_least: int = 3, least: int = 5, contrast: float = 8.0, dots_least: float = 0.05):
        docs = docs.where(F.length("text") > 0)
        h = F.xxhash64("text").alias("h")
        self.rows = materialise(docs.select("doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), h), "rows")
        m = materialise(measured(docs.select(h, "text").groupBy("h").agg(F.first("text").alias("text"))), "measured")
        e = closings(open_endings(m)).select("h", "lengths", "marked", "dots", "closing", "bracket", F.size(F.split("body", r"\s+")).alias("n_words"), "pair")
        known = sentence_ends(m).where(F.col("n") >= ends_least).select("pair", (F.col("n") / F.col("n_all")).alias("ending"))
        ends = F.coalesce(F.col("ending") > F.when(F.col("dots"), dots_least).otherwise(0.5), F.lit(False))
        e = e.join(known, "pair", "left").select("h", "lengths", "marked", (~F.col("closing") & (F.col("bracket") | ~ends) & (F.col("n_words") > 3)).alias("looks_cut"))
        self.open = materialise(e, "open")
        self.limits = materialise(self._limits(m, least, contrast), "limits")

    def _held(self, texts: DataFrame) -> DataFrame:
        """``texts`` by source and storage form: (source, h, form, len, ...), each text once for a source."""
        z = F.explode(F.arrays_zip(F.array(*map(F.lit, FORMS)).alias("form"), F.col("lengths").alias("len"))).alias("z")
        x = self.rows.select("source", "h").distinct().join(texts, "h")
        return x.select("source", "h", *(c for c in texts.columns if c not in ("h", "lengths")), z).select("*", "z.form", "z.len").drop("z")

    def _limits(self, m: DataFrame, least: int, contrast: float) -> DataFrame:
        cut = self.open.where("looks_cut").select("h", F.lit(1).alias("cut"))
        n = self._held(m.select("h", "lengths").join(cut, "h", "left")).groupBy("source", "form", "len").agg(F.count(F.lit(1)).alias("n"), F.count("cut").alias("n_cut"))
        by = Window.partitionBy("source", "form").orderBy("len")
        octets = F.col("form").contains("utf8")
        over = lambda c, lo, hi: F.coalesce(F.sum(c).over(by.rangeBetween(lo, hi)), F.lit(0))
        at = lambda c: F.when(octets, over(c, -SLACK, 0)).otherwise(F.col(c))
        near = n.select("source", "form", F.col("len").alias("cap"), at("n").alias("n_at"), at("n_cut").alias("n_cut"), ((over("n", -44, -4) + over("n", 1, 44)) / 85 * F.when(octets, SLACK + 1).otherwise(1)).alias("mean"))
        spike = (F.col("n_at") >= least + 6 * F.sqrt("mean")) & (F.col("n_at") > contrast * F.col("mean")) & (2 * F.col("n_cut") > F.col("n_at"))
        spikes = materialise(near.where(spike).select("source", "form", "cap", "n_at"), "spikes")
        on = self._held(self.open.where("looks_cut").select("h", "lengths")).join(_each_length(spikes), ["source", "form", "len"])
        best = F.max(F.struct("n_at", (F.col("form") == "code_points").alias("plain"), (-F.col("cap")).alias("low"), "form", "cap")).alias("b")
        mine = on.groupBy("source", "h").agg(best).groupBy("source", "b.form", "b.cap", "b.n_at").agg(F.count(F.lit(1)).alias("own"))
        return mine.where((F.col("own") >= least) & (2 * F.col("own") > F.col("n_at"))).select("source", "form", "cap", "n_at")

    def judged(self) -> DataFrame:
        """(doc_id, source, at_limit, marked, truncated) of every row; at_limit is given of texts that end without a stop."""
        x = self._held(self.open.select("h", "lengths"))
        limits = _each_length(self.limits)
        own = x.join(limits, ["source", "form", "len"]).select("source", "h")
        none = x.where(F.col("source") == NO_SOURCE).join(limits.drop("source"), ["form", "len"]).select("source", "h")
        at = own.unionByName(none).distinct().withColumn("at_limit", F.lit(True))
        r = self.rows.join(self.open.select("h", "marked", "looks_cut"), "h", "left").join(at, ["source", "h"], "left")
        at_limit, cut = F.coalesce("at_limit", F.lit(False)), F.coalesce("looks_cut", F.lit(False))
        return r.select("doc_id", F.nullif("source", F.lit(NO_SOURCE)).alias("source"), at_limit.alias("at_limit"), F.coalesce("marked", F.lit(False)).alias("marked"), (at_limit | cut).alias("truncated"))


#: Stands for a null source.
NO_SOURCE = "\0"


def _plain(ending: Column) -> Column:
    """Whether an ending has one stop and at most quotes after it: nothing was added, nothing is missing."""
    return F.right(ending, F.lit(12)).rlike(r"[^.…\s][.!?。！？][\"'”’»]*$")


def _each_length(limits: DataFrame) -> DataFrame:
    """A row for each length that counts as being at a limit."""
    slack = F.when(F.col("form").contains("utf8"), SLACK).otherwise(0)
    return limits.select("source", "form", "cap", "n_at", F.explode(F.sequence(F.col("cap") - slack, F.col("cap"))).alias("len"))


def _corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Corpus:
    return Corpus(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))


def storage_limits(df: DataFrame, **columns: str) -> DataFrame:
    """(source, form, cap, n_at) of each length at which a source cuts."""
    return _corpus(df, **columns).limits.select(F.nullif("source", F.lit(NO_SOURCE)).alias("source"), "form", F.col("cap").cast("long").alias("cap"), "n_at")


def truncated(df: DataFrame, **columns: str) -> DataFrame:
    return _corpus(df, **columns).judged().where("truncated").select("doc_id").distinct()


def report(df: DataFrame, **columns: str) -> DataFrame:
    """(source, n_texts, n_truncated, share) over the texts that aren't null or empty."""
    n = _corpus(df, **columns).judged().groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"))
    return n.withColumn("share", F.col("n_truncated") / F.col("n_texts"))
