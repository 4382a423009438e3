"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (languages x buckets) is small and of fixed width, so it is
broadcast; texts are scored in batches: n-grams are hashed and their log-probabilities
summed by numpy. Priors are the languages' shares of all labelled rows. The posterior of a long text is
near 1 whatever it says, so a text is held to be of an unknown language when its n-grams
are less likely, on the mean, than under a background model of independent characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .kernel import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)  # successive ones from 1 on, which the background counts on
UNKNOWN = "und"


def grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each order, the buckets of all n-grams of the lower-cased texts and where each text's begin.

    A text is framed by a space on either side, so it has an n-gram of each order.
    """
    low = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    length = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    points = np.frombuffer("".join(f" {x} " for x in low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(length) - length
    out, code = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[:-1] if n > 1 else code) * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            out.append((((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int64), first))
    return out, len(length)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray  # log shares of the languages

    def predict(self, texts: pa.Array, junk: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The likeliest language of each text, its posterior probability, ties to the first name; and with
        `junk` by how much the mean log-probability of an n-gram under it is above the background's.

        The background takes characters to be independent, each as likely as the language says, and knows
        every n-gram with the chance of a bucket at least.
        """
        found, n = grams(texts)
        total = np.zeros((n, len(self.langs)))
        for order, (bucket, first) in zip(ORDERS, found, strict=True):
            ends = np.append(first[1:], len(bucket) + order - 1) - (order - 1)
            cuts = np.stack([first, np.minimum(ends, len(bucket))], 1).ravel()
            for k in range(len(self.langs)):
                value = np.append(self.logp[:, k][bucket], 0.0)
                total[:, k] += np.add.reduceat(value, cuts)[::2]
        total += self.prior
        best = total.argmax(1)
        above = self._above(found, best) if junk else None
        return best, 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1), above

    def _above(self, found: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> np.ndarray:
        share, flat, langs = np.float32(np.log(len(ORDERS))), self.logp.ravel(), len(self.langs)
        letters, first = found[0]
        size = np.diff(np.append(first, len(letters)))
        lang = np.repeat(best, size)
        alone = flat[letters * langs + lang] + share
        above, count, chance = np.zeros(len(best)), np.zeros(len(best)), np.zeros(len(letters), np.float32)
        for order, (bucket, _) in zip(ORDERS, found, strict=True):
            chance = chance[: len(bucket)] + alone[order - 1 :]
            excess = flat[bucket * langs + lang[: len(bucket)]] - np.maximum(chance - share, np.float32(-np.log(BUCKETS)))
            cuts = np.stack([first, first + size - order + 1], 1).ravel()
            above += np.add.reduceat(np.append(excess, [0.0] * order), cuts)[::2]
            count += size - order + 1
        return above / count


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = 4000) -> Model:
    """Fits on about `rows_per_language` labelled rows of each language, chosen by a hash of doc_id.

    Rows that are held out, and those without text, lang or doc_id, are not learned from; priors
    are shares of all others. Counts are smoothed by one half. Without rows nothing is learned.
    """
    known = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(1_000_003 * min(1.0, rows_per_language / counts[k]))))]), F.col("lang"))
    at = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = grams(part["text"])
                which = np.array([at[x] for x in part["lang"].to_pylist()])
                for order, (bucket, first) in zip(ORDERS, found, strict=True):
                    ends = np.append(first[1:], len(bucket) + order - 1)
                    label = np.repeat(which, ends - first)[: len(bucket)]
                    inside = np.arange(len(bucket)) + order <= np.repeat(ends, ends - first)[: len(bucket)]
                    table += np.bincount(label[inside] * BUCKETS + bucket[inside], minlength=table.size).reshape(table.shape)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array([table[k].tobytes() for k in used.tolist()], pa.binary())], names=["lang", "counts"])

    def total(part: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(c.as_py(), np.int64) for c in part["counts"])
        return pa.table([part["lang"].slice(0, 1), pa.array([whole.tobytes()], pa.binary())], names=["lang", "counts"])

    drawn = known.where(lot < share).select("lang", "text").repartition(8)
    table = np.full((len(langs), BUCKETS), 0.5)
    for row in drawn.mapInArrow(count, "lang int, counts binary").groupBy("lang").applyInArrow(total, "lang int, counts binary").collect():  # a row for each language
        table[row.lang] += np.frombuffer(row.counts, np.int64)
    return Model(langs, np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32), np.log([counts[k] / sum(counts.values()) for k in langs]))


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, by the whole text alone.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or nothing
    was learned; otherwise score is the posterior probability. Ties go to the first name in
    order. Repeated rows each give a row; a null doc_id isn't held out; an empty table gives none.
    """
    shared = spark.sparkContext.broadcast((model.langs, model.logp, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                lettered = part["lettered"].to_numpy(zero_copy_only=False).astype(bool) & bool(own.langs)
                names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if lettered.any():
                    best, sure, _ = own.predict(part["text"])
                    names = [own.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    score = np.where(lettered, sure, 0.0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(names), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    asked = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


_WORDS = re.compile(r"(?<![\w])[^\W\d_]+(?![\w])")


def keep_known(spark: SparkSession, docs: DataFrame, model: Model, least: float = -1.0) -> DataFrame:
    """The documents whose text is of a language that was learned, columns unchanged.

    A document stays if its n-grams, or those of its words of letters alone (numbers, keys and
    marks say nothing of a language), are above the background by `least` on the mean (below it by default, for names and foreign phrases; random letters and other languages are lower still). Null and empty texts
    and those without a letter go; each repeated row and rows with a null doc_id are judged by their texts alone;
    an empty table, or a model without languages, gives no rows.
    """
    shared = spark.sparkContext.broadcast((model.langs, model.logp, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                if own.langs:
                    keep = own.predict(part["text"], True)[2] >= least
                    odd = np.flatnonzero(~keep)
                    if len(odd):
                        words = [" ".join(_WORDS.findall(part["text"][i].as_py())) for i in odd.tolist()]
                        keep[odd] = (own.predict(pa.array(words, pa.string()), True)[2] >= least) & np.array([w != "" for w in words])
                    yield part.filter(pa.array(keep))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
