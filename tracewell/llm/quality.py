"""Quality rules: hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over
every document, one over the trusted ones (labelled quality 1 and not toxic). A
document's score is the mean, over its n-grams, of log p_trusted - log p_raw; it is
kept when its score reaches a threshold fitted on all labelled documents, and when its
base counts don't fail it.

Passes: one scan to count, one to count the trusted documents, whose texts are
shuffled to meet their labels, one scan to score; where texts are wanted, the labelled
documents are scored for the threshold beforehand. What meets on the driver is one count
per hash slot (SLOTS) and one row per bin of scores (BINS)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import maybe_in, staged, windows, word_hashes

SLOTS = 1 << 14
#: Bins of equal width that scores are dealt to while the threshold is fitted (speed only).
BINS = 4096
#: Dropping a trusted document counts as so many kept bad ones when the threshold is fitted.
CLEAN_WEIGHT = 20.0
SMOOTHING = 1.0
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_SPACES = np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", dtype=np.uint8)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def ngram_slots(h: np.ndarray) -> np.ndarray:
    return (np.concatenate((windows(h, 1), windows(h, 2))) % np.uint64(SLOTS)).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words inside a WINDOW-word window that occurs twice or more, the first included."""
    w = windows(h, WINDOW)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def repeated_lines(data: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in data.split(b"\n"):
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


def base_counts(data: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    raw = np.frombuffer(data, dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    points = len(raw) - int(seen[0x80:0xC0].sum())
    return len(h), points - int(seen[_SPACES].sum()), int(seen[_SYMBOLS].sum()), repeated_lines(data), repeated_words(h)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS, dtype=np.int64)
    for b in batches:
        for text in b.column("text").to_pylist():
            n += np.bincount(ngram_slots(word_hashes(_bytes(text))), minlength=SLOTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"slot": at, "n": n[at]})


def labelled(labels: DataFrame) -> DataFrame:
    """Every labelled document: doc_id, trusted. Quality 1
    without toxicity is trusted; toxic rows and other qualities are bad, whatever
    the other label. Quality 1 of unknown toxicity, and an unknown quality that isn't
    toxic, say neither and are left out, as are documents whose rows disagree."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    verdict = F.when(toxic | ~good, False).when(good & (F.col("toxic") == 0), True)
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), verdict.alias("trusted")).where("trusted is not null")
    return known.groupBy("doc_id").agg(F.min("trusted").alias("trusted"), F.max("trusted").alias("also")).where("trusted = also").drop("also")


#: Its name while it drew a sample.
labelled_sample = labelled


def _slot_counts(docs: DataFrame) -> np.ndarray:
    rows = docs.select("text").mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS)
    out[rows["slot"]] = rows["n"]
    return out


def log_ratio(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw by slot; all zero without trusted documents."""
    trusted = known.where("trusted").select("doc_id")
    # Labels grow with the documents: never broadcast. The bit map keeps other texts out of the shuffle.
    good = _slot_counts(maybe_in(docs, trusted).select("doc_id", "text").join(trusted.hint("merge"), "doc_id"))
    if good.sum() == 0:
        return np.zeros(SLOTS)
    share = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * SLOTS)
    return np.log(share(good)) - np.log(share(_slot_counts(docs)))


def fitted_threshold(known: DataFrame) -> float:
    """known(score, trusted) -> the cut of least weighted error; of equal cuts the lowest,
    set halfway to the score below it. Without both kinds of rows: keep everything.

    Scores are dealt to bins in their order; sums of whole bins meet on the driver, and
    each bin is gone through in a task."""
    each = staged(known.groupBy("score").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")), "scores")
    total = each.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return float("-inf")
    width = (total["high"] - total["low"]) / BINS or 1.0
    binned = each.withColumn("bin", F.least(F.floor((F.col("score") - total["low"]) / width), F.lit(BINS - 1)).cast("int"))
    sums = sorted(binned.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("top")).collect())
    before, good, bad, top = [], 0, 0, None
    for b in sums:
        before.append((b["bin"], good, bad, top))
        good, bad, top = good + b["good"], bad + b["bad"], b["top"]
    # At most BINS rows, broadcast.
    binned = binned.join(F.broadcast(known.sparkSession.createDataFrame(before, "bin int, good_before long, bad_before long, top double")), "bin")
    here = Window.partitionBy("bin").orderBy("score")
    under = here.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(under), F.lit(0))
    error = CLEAN_WEIGHT * below("good") + (total["bad"] - below("bad"))
    cuts = binned.select("score", error.alias("error"), F.coalesce(F.lag("score").over(here), F.col("top")).alias("under"))
    best = cuts.agg(F.min(F.struct("error", "score", "under")).alias("best")).first()["best"]
    return float("-inf") if best["under"] is None else float((best["score"] + best["under"]) / 2)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _judge(docs: DataFrame, known: DataFrame):
    """A function of a text column: the base counts and the score."""
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, known))

    @F.pandas_udf(f"{BASE}, score double")
    def judged(text: pd.Series) -> pd.DataFrame:
        ratio, rows = sent.value, []
        for t in text:
            data = _bytes(t)
            h = word_hashes(data)
            rows.append((*base_counts(data, h), float(ratio[ngram_slots(h)].mean()) if len(h) else 0.0))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return judged


def _failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{c}.n_words"))


def _cut(scored: DataFrame, known: DataFrame) -> float:
    """scored(doc_id, v) -> the threshold fitted on the labelled ones that pass the base rules."""
    rows = scored.select("doc_id", "v.score", _failed("v").alias("failed")).join(known.hint("merge"), "doc_id")
    return fitted_threshold(rows.where("not failed").select("score", "trusted"))


def _kept(c: str, cut: float) -> Column:
    return ~_failed(c) & (F.col(f"{c}.score") >= F.lit(cut))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, score, base_failed, kept. Null texts have
    no words and fail the base rules. Documents that aren't labelled, or whose doc_id is
    null, are scored alike."""
    known = labelled(labels)
    judged = _judge(_plain(docs), known)
    scored = staged(docs.select("doc_id", judged(F.col("text").cast("string")).alias("v")), "judged")
    cut = _cut(scored.withColumn("doc_id", F.col("doc_id").cast("long")), known)
    return scored.select("doc_id", "v.*", _failed("v").alias("base_failed"), _kept("v", cut).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with docs' own columns."""
    known, plain = labelled(labels), _plain(docs)
    judged = _judge(plain, known)
    cut = _cut(maybe_in(plain, known).select("doc_id", judged("text").alias("v")), known)
    scored = docs.withColumn("__v", judged(F.col("text").cast("string")))
    return scored.where(_kept("__v", cut)).select(*[F.col(f"`{c}`") for c in docs.columns])
