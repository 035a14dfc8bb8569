"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER bytes long. A byte's code length in a language is that
of the longest context the language has seen: its share there, or the escape (method C) to the next shorter
context, with the bytes already ruled out excluded, down to all bytes alike. The statistics are frozen after
training, so a text's exact code length in every language is a sum over its contexts. The shortest code wins.

A tree is kept sparse: for every order the (context, byte) codes that were seen, in order, with their counts,
and for every context its total, its number of bytes and the share of the next shorter context that it
excludes. What a longer context has seen a shorter one has too, so that share is all that exclusion needs. A
tree holds at most ORDER + 1 numbers pairs a byte of its sample; code lengths are worked out for the codes
that texts hold, CACHE of which a task remembers.

Training reads a sample of PER_LANGUAGE distinct documents of each language, fewer where SAMPLE_DOCS over all
languages would be passed, but one at least of every language; they are picked by a hash of the row, and of a
longer document a stretch of SAMPLE_CHARS, placed by that hash.

Defined results: null texts, texts without a letter and any text when nothing was learned get ``und`` and
score 0; equal code lengths go to the smaller language name; a null id is not held out (its fold is
unknown) and does not train; repeated rows are answered once each and train once; extra columns are ignored;
an empty table gives an empty answer. score is the winner's posterior under equal priors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLOTS, Columns, arrow_rows, fold, slot

ORDER = 3
PER_LANGUAGE, SAMPLE_DOCS, SAMPLE_CHARS = 400, 4000, 8 << 10
#: Codes whose lengths a task remembers.
CACHE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Text bytes scored at a time.
PART = 1 << 20


def prepared(text: str) -> bytes:
    """Bytes that are modelled: lower case, white space and digits evened out, led by a space."""
    return b" " + re.sub(r"[\s\d]+", " ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class Contexts:
    """One order of a language's tree. codes: context * symbols + symbol, sorted, with their counts; owners: the
    contexts, sorted, with their total, number of symbols, and how much of the shorter context's total the
    symbols seen here have there."""

    codes: np.ndarray
    counts: np.ndarray
    owners: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    excluded: np.ndarray


def found(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value."""
    at = np.searchsorted(sorted_, wanted)
    at[at == len(sorted_)] = 0
    return at, (sorted_[at] == wanted if len(sorted_) else np.zeros(len(wanted), dtype=bool))


def grown(texts: list[bytes], symbol: bytes, n: int, order: int) -> list[Contexts]:
    """A language's tree, order 0 first."""
    out: list[Contexts] = []
    for k in range(order + 1):
        codes, counts = count_contexts(texts, symbol, n, k)
        owners, first = np.unique(codes // n, return_index=True)
        total = np.add.reduceat(counts, first) if len(first) else np.empty(0, dtype=np.int64)
        kinds = np.diff(np.r_[first, len(codes)])
        if k:
            at, _ = found(out[-1].codes, codes % n**k)  # what a context has seen its suffix has
            excluded = np.add.reduceat(out[-1].counts[at], first) if len(first) else total
        else:
            excluded = np.zeros(len(owners), dtype=np.int64)
        out.append(Contexts(codes, counts.astype(np.int32), owners, total.astype(np.int32), kinds.astype(np.int16), excluded.astype(np.int32)))
    return out


def code_bits(tree: list[Contexts], codes: np.ndarray, n: int) -> np.ndarray:
    """Bits of each (longest context, symbol) code in a language."""
    order = len(tree) - 1
    bits, open_ = np.zeros(len(codes)), np.ones(len(codes), dtype=bool)
    gone, ruled = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)  # excluded here, and kinds
    for k in range(order, -1, -1):
        level, own = tree[k], codes % n ** (k + 1)
        at, there = found(level.owners, own // n)
        total = np.where(there, level.total[at] if len(level.owners) else 0, 0) - gone
        kinds = np.where(there, level.kinds[at] if len(level.owners) else 0, 0) - ruled
        place, seen = found(level.codes, own)
        live = open_ & there & (kinds > 0)
        hit = live & seen
        if hit.any():
            bits[hit] += np.log2((total[hit] + kinds[hit]) / level.counts[place[hit]])
        open_ &= ~hit
        out = live & ~seen
        bits[out] += np.log2((total[out] + kinds[out]) / kinds[out])
        if k:
            gone = np.where(there, level.excluded[at] if len(level.owners) else 0, 0)
            ruled = np.where(there, level.kinds[at] if len(level.owners) else 0, 0)
        else:
            ruled = np.where(there, level.kinds[at] if len(level.owners) else 0, 0)
    return bits + np.where(open_, np.log2(np.maximum(1, n - ruled)), 0.0)


class Model:
    """Trees by language. symbol: byte to symbol number."""

    def __init__(self, languages: tuple[str, ...], symbol: bytes, n_symbols: int, trees: list[list[Contexts]]) -> None:
        self.languages, self.symbol, self.n_symbols, self.trees = languages, symbol, n_symbols, trees
        self._forget()

    def _forget(self) -> None:
        self._known, self._bits = np.empty(0, dtype=np.int64), np.empty((len(self.languages), 0), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_bits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Columns of _bits that hold the codes' lengths; new ones are worked out."""
        at, there = found(self._known, codes)
        if not there.all():
            fresh = np.unique(codes[~there])
            if len(self._known) + len(fresh) > CACHE:
                self._forget()
                fresh = np.unique(codes)
            more = np.array([code_bits(t, fresh, self.n_symbols) for t in self.trees], dtype=np.float32)
            known = np.concatenate((self._known, fresh))
            order = np.argsort(known, kind="stable")
            self._known, self._bits = known[order], np.concatenate((self._bits, more), axis=1)[:, order]
            at = np.searchsorted(self._known, codes)
        return at

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        n, total = self.n_symbols, np.zeros((len(texts), len(self.languages)))
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= PART):
                size += len(texts[b])
                b += 1
            # ORDER spaces before each text end the context of the one before
            lead = b" " * ORDER
            joined = np.frombuffer((lead + lead.join(texts[a:b])).translate(self.symbol), dtype=np.uint8).astype(np.int64)
            code = np.zeros(len(joined) - ORDER, dtype=np.int64)
            for k in range(ORDER + 1):
                code = code * n + joined[k : len(joined) - ORDER + k]
            starts = np.cumsum([0] + [len(t) + ORDER for t in texts[a : b - 1]])
            ends = starts + [len(t) for t in texts[a:b]]
            for i in range(0, len(code), PART):  # a long text is taken in stretches
                at = self.places(code[i : i + PART])
                for k in range(len(self.languages)):
                    bits = np.concatenate(([0.0], np.cumsum(self._bits[k][at], dtype=np.float64)))
                    total[a:b, k] += bits[np.clip(ends - i, 0, len(at))] - bits[np.clip(starts - i, 0, len(at))]
            a = b
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not known or not self.languages:
            return out
        bits = self.lengths([prepared(texts[i]) for i in known])
        best = bits.argmin(axis=1)
        share = 1.0 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
        for i, k, p in zip(known, best.tolist(), share.tolist()):
            out[i] = (self.languages[k], float(p))
        return out


def count_contexts(texts: list[bytes], symbol: bytes, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of (order context symbols, symbol) and their counts."""
    parts = []
    for t in texts:
        s = np.frombuffer((b" " * order + t).translate(symbol), dtype=np.uint8).astype(np.int64)
        code = np.zeros(len(s) - order, dtype=np.int64)
        for k in range(order + 1):
            code = code * n + s[k : len(s) - order + k]
        parts.append(code)
    return np.unique(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64), return_counts=True)


def train(samples: dict[str, list[str]]) -> Model:
    """Model of whole texts by language."""
    languages = tuple(sorted(k for k, v in samples.items() if v))
    if not languages:
        return Model((), bytes(256), 1, [])
    coded = {lang: [prepared(t) for t in samples[lang]] for lang in languages}
    seen = np.bincount(np.frombuffer(b"".join(t for ts in coded.values() for t in ts) + b" ", dtype=np.uint8), minlength=256)
    alphabet = np.flatnonzero(seen)
    n = len(alphabet) + 1  # the last symbol stands for every byte that training never saw
    symbol = bytearray([n - 1] * 256)
    for i, b in enumerate(alphabet):
        symbol[b] = i
    return Model(languages, bytes(symbol), n, [grown(coded[lang], bytes(symbol), n, ORDER) for lang in languages])


def sample(docs: DataFrame, use: Column, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Texts by language, bounded as the module says; the share a language gives follows from its distinct texts."""
    text = F.col(text_col)
    rest = F.length(text) - SAMPLE_CHARS
    start = F.when(rest > 0, F.pmod(F.xxhash64("doc_id"), rest + 1)).otherwise(F.lit(0)).cast("int")
    rows = docs.where(use & F.col(lang_col).isNotNull() & text.isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.substring(text, start + 1, F.lit(SAMPLE_CHARS)).alias("t"), F.xxhash64(text).alias("h"), slot("doc_id").alias("s"))
    told = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min_by(F.struct("h", "t"), F.struct("s", "h")).alias("one")).collect()
    if not told:
        return {}
    each = min(PER_LANGUAGE, max(1, SAMPLE_DOCS // len(told)))
    share = F.create_map(*(x for r in told for x in (F.lit(r["lang"]), F.lit(min(SLOTS, SLOTS * each // max(1, r["n"]) + 1)))))
    picked = rows.where(F.col("s") < F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.first("t").alias("t")).collect()
    out = {r["lang"]: {r["one"]["h"]: r["one"]["t"]} for r in told}
    for r in picked:
        out[r["lang"]][r["h"]] = r["t"]
    return {lang: [t for _, t in sorted(texts.items())] for lang, texts in out.items()}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            found = sent.value.predict(b["text"])
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_rows(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(sample(docs, fold("doc_id", 3) != 1, "text", "lang"))
    return identify(docs, model, held_out=fold("doc_id", 3) == 1)
