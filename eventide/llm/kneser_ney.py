"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted text.

Counts, continuation counts, discounts and interpolated probabilities are
DataFrame aggregates and joins on the n-gram, sharded by Spark. Scoring joins
every n-gram of every document with the model's shards: the model is cut into
shards of a bounded number of entries by the characters before the predicted
one (so all orders of a position lie in one shard). A pass takes shards up to
that bound, goes over the documents of their languages as a size-checked
map-side join, and writes partial sums; the driver holds one pass's shards at a
time, whatever the size of the model, and documents are never shuffled. A
document is kept if its perplexity stays under a threshold from a quantile of
its language's trusted documents that were held out of training.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, checkpointed

ORDER = 5
BOS = "\x02"
#: Entries (16 bytes each) of a pass's shards: what the driver and a task hold at once.
SHARD_ENTRIES = 2_000_000
#: Distinct n-grams that a task holds before it passes them on.
HELD_GRAMS = 400_000
#: Trusted ids are broadcast up to so many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000
#: N-grams that a task looks up in one go.
CHUNK = 100_000
#: A document is kept up to SLACK times this quantile of its language's held-out trusted perplexities.
QUANTILE, SLACK = 0.995, 1.2
#: Accuracy of the quantiles: one in so many.
ACCURACY = 100_000
#: One in so many trusted documents sets the thresholds and is not trained on.
HELD_OUT = 5
BLANKS = re.compile(r"\s{2,}|[^\S ]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def tidy(text: str | None) -> str:
    """White space as single blanks."""
    return BLANKS.sub(" ", text or "").strip()


def _hash(columns: list[np.ndarray], seed: np.ndarray | int) -> np.ndarray:
    """Hashes of the n-grams whose k-th characters are columns[k], per language seed."""
    h = np.full(1, seed, np.uint64) + np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for c in columns:
        h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * MIX
        h ^= h >> np.uint64(31)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer((BOS * (ORDER - 1) + text).encode("utf-32-le", "replace"), np.uint32)


def _windows(text: str | None) -> np.ndarray:
    """Rows of ORDER characters, one for each character of the tidy text: a view of its code points."""
    points = _points(tidy(text))
    return np.lib.stride_tricks.sliding_window_view(points, ORDER) if len(points) >= ORDER else np.zeros((0, ORDER), np.uint32)


def _chunks(windows: list[np.ndarray]):
    """(rows, the window they come from) of CHUNK rows at a time: long texts are cut, short ones put together."""
    held, owners, n = [], [], 0
    for i, w in enumerate(windows):
        for start in range(0, len(w), CHUNK):
            held.append(w[start : start + CHUNK])
            owners.append(np.full(len(held[-1]), i))
            n += len(held[-1])
            if n >= CHUNK:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, c)``: occurrences of every n-gram of the highest order, pre-aggregated over a task's batches."""

    def rows_of(held: dict[str, Counter]):
        for lang, counts in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "gram": pa.array(list(counts), pa.string()), "c": pa.array(list(counts.values()), pa.int64())})

    def count(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).append(_windows(text.as_py()))
            for lang, grams in ((lang, grams) for lang, found in by.items() for grams, _ in _chunks(found)):
                _, first, n = np.unique(_hash([grams[:, k] for k in range(ORDER)], 0), return_index=True, return_counts=True)
                texts = grams[first].astype("<u4").tobytes().decode("utf-32-le")
                counts = held.setdefault(lang, Counter())
                for i, c in enumerate(n.tolist()):
                    counts[texts[ORDER * i : ORDER * (i + 1)]] += c
            if sum(map(len, held.values())) > HELD_GRAMS:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    chosen = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def all_counts(counts: DataFrame) -> DataFrame:
    """``(lang, k, gram, c)`` of every order: the highest as counted, lower ones by the distinct characters before them."""
    ends = F.explode(F.array(*[F.expr(f"right(gram, {m})") for m in range(2, ORDER)]))
    types = counts.select("lang", ends.alias("gram")).distinct().union(counts.select("lang", "gram"))
    lower = types.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
    return counts.select("lang", F.lit(ORDER).alias("k"), "gram", "c").union(lower.select("lang", F.length("gram").alias("k"), "gram", "c"))


def discounts(counts: DataFrame) -> DataFrame:
    """``(lang, k, d1, d2, d3)`` by the counts of counts 1 to 4; half of the count where they give none."""
    n1, n2, n3, n4 = (F.sum((F.col("c") == k).cast("double")) for k in (1, 2, 3, 4))
    n = counts.groupBy("lang", "k").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    raw = lambda k, a, b: F.lit(float(k)) - F.try_divide((k + 1) * y * F.col(b), F.col(a))
    sane = lambda d, k: F.when((d > 0) & (d < k), d).otherwise(F.lit(k / 2))
    return n.select("lang", "k", sane(raw(1, "n1", "n2"), 1).alias("d1"), sane(raw(2, "n2", "n3"), 2).alias("d2"), sane(raw(3, "n3", "n4"), 3).alias("d3"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, k, gram, logp, logb)``: interpolated log-probability of every seen n-gram
    of every order, and the log back-off weight of the n-gram as a context (null if it is none).
    The empty n-gram (k = 0) holds the probability of an unseen character."""
    counts = checkpointed(all_counts(gram_counts(docs, text_col, lang_col)))
    rows = counts.join(F.broadcast(discounts(counts)), ["lang", "k"])  # ORDER rows for each language
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = Window.partitionBy("lang", "context")  # as many rows as characters follow a context
    rows = rows.select("lang", "k", "gram", "c", d.alias("d"), F.expr("substring(gram, 1, k - 1)").alias("context"))
    rows = rows.withColumn("total", F.sum("c").over(own)).withColumn("back", F.sum("d").over(own) / F.col("total")).withColumn("n", F.count("*").over(own))
    rows = checkpointed(rows.select("lang", "k", "gram", "context", ((F.col("c") - F.col("d")) / F.col("total")).alias("part"), "back", "n"))
    level = rows.where("k = 1").withColumn("low", 1 / (F.col("n") + 1))
    unseen = level.groupBy("lang").agg(F.first(F.log(F.col("back") * F.col("low"))).alias("logp"))
    p = F.col("part") + F.col("back") * F.col("low")
    below = level.select("lang", "gram", p.alias("p"))
    scored = below
    for k in range(2, ORDER + 1):
        low = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        joined = rows.where(F.col("k") == k).withColumn("suffix", F.expr("substring(gram, 2)")).join(low, ["lang", "suffix"])
        below = joined.select("lang", "gram", p.alias("p"))
        scored = scored.union(below)
    backs = rows.where("k > 1").groupBy("lang", F.col("context").alias("gram")).agg(F.first(F.log("back")).alias("logb"))
    out = scored.select("lang", "gram", F.log("p").alias("logp")).join(backs, ["lang", "gram"], "full").select("lang", F.length("gram").alias("k"), "gram", "logp", "logb")
    return out.union(unseen.select("lang", F.lit(0).alias("k"), F.lit("").alias("gram"), "logp", F.lit(None).cast("double").alias("logb")))


def _shard_key(before: np.ndarray, shards: int) -> np.ndarray:
    """Shards of rows of the characters before the predicted ones."""
    return (_hash([before[:, k] for k in range(before.shape[1])], 1) % np.uint64(shards)).astype(np.int64)


class Shard:
    """Open-addressed table of a pass's n-grams: log-probability and back-off weight by hash.

    own: for each language of the pass, (characters that its shards are told by, number of shards, those in the pass).
    """

    def __init__(self, own: dict[str, tuple[int, int, list[int]]], keys: np.ndarray, logp: np.ndarray, logb: np.ndarray, floors: dict[str, float]):
        self.own, self.floors = own, floors
        self.seeds = _seeds(floors)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.logp, self.logb = np.zeros(size, np.uint64), np.full(size, np.nan, np.float32), np.full(size, np.nan, np.float32)
        at, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.logp[at[put]], self.logb[at[put]] = keys[put], logp[put], logb[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of every hash, -1 where it isn't in the shard."""
        at = hashes & self.mask
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            held = self.keys[at[left]]
            hit = held == hashes[left]
            out[left[hit]] = at[left[hit]].astype(np.int64)
            left = left[~hit & (held != 0)]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        return out

    def mine(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """The rows whose n-grams lie in the pass's shards."""
        depth, shards, numbers = self.own[lang]
        if len(numbers) == shards:
            return np.arange(len(grams))
        return np.flatnonzero(np.isin(_shard_key(grams[:, ORDER - 1 - depth : ORDER - 1], shards), numbers))

    def score(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the last characters of rows of ORDER characters."""
        seed = self.seeds[lang]
        out = np.full(len(grams), self.floors[lang])
        done = np.zeros(len(grams), bool)
        backed = np.zeros(len(grams))
        for k in range(ORDER, 0, -1):
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            part = grams[todo]
            at = self.find(_hash([part[:, j] for j in range(ORDER - k, ORDER)], seed) | np.uint64(1))
            p = np.where(at >= 0, self.logp[at], np.nan)
            hit = ~np.isnan(p)
            out[todo[hit]] = p[hit]
            done[todo[hit]] = True
            if k > 1 and not hit.all():
                todo, part = todo[~hit], part[~hit]
                at = self.find(_hash([part[:, j] for j in range(ORDER - k, ORDER - 1)], seed) | np.uint64(1))
                b = np.where(at >= 0, self.logb[at], np.nan)
                backed[todo] += np.where(np.isnan(b), 0.0, b)
        return out + backed


def _seeds(languages) -> dict[str, int]:
    """Seeds that differ in their high bits, which characters don't reach."""
    return {lang: (i + 2) * 0xD1B54A32D192ED03 % 2**64 for i, lang in enumerate(sorted(languages))}


def place(model: DataFrame, plan: dict[str, tuple[int, int]]) -> DataFrame:
    """``(lang, shard, long, key, logp, logb)``: n-grams hashed and dealt to their language's shards.

    plan: for each language, how many characters tell its shards and how many
    there are. N-grams of no more characters than that aren't long and go to all shards.
    """
    seeds = _seeds(plan)

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for (lang, k), rows in frame.groupby(["lang", "k"]):
                depth, shards = plan[lang]
                points = np.frombuffer("".join(rows["gram"]).encode("utf-32-le", "replace"), np.uint32).reshape(-1, k)
                keys = _hash([points[:, j] for j in range(k)], seeds[lang]) | np.uint64(1)
                out = pd.DataFrame({"lang": lang, "long": True, "key": keys.view(np.int64), "logp": rows["logp"].to_numpy(), "logb": rows["logb"].to_numpy()})
                if shards == 1:
                    placed = [out.assign(shard=0, long=k > depth)]
                elif k <= depth:
                    placed = [out.assign(shard=s, long=False) for s in range(shards)]
                else:
                    # as a predicted n-gram by the characters before its last, as a context by its last ones
                    gram = out.assign(shard=_shard_key(points[:, -1 - depth : -1], shards))
                    context = out.assign(shard=_shard_key(points[:, -depth:], shards), logp=np.nan)
                    placed = [gram, context[rows["logb"].notna().to_numpy() & (context["shard"] != gram["shard"]).to_numpy()]]
                yield pa.RecordBatch.from_pandas(pd.concat(placed)[["lang", "shard", "long", "key", "logp", "logb"]].astype({"shard": "int32"}), preserve_index=False)

    return model.select("lang", "k", "gram", "logp", "logb").mapInArrow(run, "lang string, shard int, long boolean, key long, logp double, logb double")


def shards_of(model: DataFrame, shard_entries: int = SHARD_ENTRIES) -> tuple[DataFrame, dict[str, tuple[int, int]], list[tuple[str, int, int]]]:
    """(placed model, its plan, ``(lang, shard, entries)`` of all shards), none with more than ``shard_entries`` long ones.

    A language's shards are doubled while that makes the largest smaller; where
    a few frequent pairs of characters stay too large, one more character tells
    them apart, up to ORDER - 1: then a shard is one context's followers at worst.
    """
    sizes = {r["lang"]: r["count"] for r in model.where("k > 2").groupBy("lang").count().collect()}  # one row for each language
    plan = {r["lang"]: (2, 1 << max(0, (-(-sizes.get(r["lang"], 0) // shard_entries) - 1).bit_length())) for r in model.where("k = 0").collect()}
    before: dict[str, float] = {}
    while True:
        placed = checkpointed(place(model.where("k > 0"), plan))
        counts = placed.groupBy("lang", "shard").agg(F.count("*").alias("n"), F.count_if("long").alias("long")).collect()  # as many rows as shards
        largest: dict[str, int] = {}
        for r in counts:
            largest[r["lang"]] = max(r["long"], largest.get(r["lang"], 0))
        again = False
        for lang, n in largest.items():
            depth, shards = plan[lang]
            stuck = n > 0.7 * before.get(lang, float("inf"))
            before[lang] = n
            if n > shard_entries and not (stuck and depth == ORDER - 1):
                plan[lang], again = (depth + 1, shards) if stuck else (depth, 2 * shards), True
        if not again:
            return placed, plan, [(r["lang"], r["shard"], r["n"]) for r in counts]


def passes(counts: list[tuple[str, int, int]], shard_entries: int = SHARD_ENTRIES) -> list[dict[str, list[int]]]:
    """The shards by pass: consecutive ones up to ``shard_entries`` together."""
    out, n = [], shard_entries
    for lang, shard, entries in sorted(counts):
        if n + entries > shard_entries:
            out.append({})
            n = 0
        out[-1].setdefault(lang, []).append(shard)
        n += entries
    return out


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """docs with ``n_scored`` (characters) and ``log_prob`` (natural), null where the language has no model.

    Every pass writes partial sums by row; rows that agree in the text and the language share theirs.
    """
    spark = docs.sparkSession
    floors = {r["lang"]: r["logp"] for r in model.where("k = 0").collect()}  # one row for each language
    placed, plan, counts = shards_of(model, shard_entries)
    keys = {"k1": F.xxhash64(text_col, lang_col), "k2": F.hash(text_col, lang_col)}
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), *[k.alias(c) for c, k in keys.items()])
    found = None
    for number, own in enumerate(passes(counts, shard_entries)):
        mine = F.concat_ws("\x00", "lang", F.col("shard").cast("string")).isin([f"{lang}\x00{s}" for lang, numbers in own.items() for s in numbers])
        # shards that meet in a pass may both hold an n-gram, once as predicted and once as a context
        t = placed.where(mine).groupBy("key").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb")).toArrow()
        entries = [t.column(c).to_numpy().astype(kind) for c, kind in (("key", np.int64), ("logp", np.float32), ("logb", np.float32))]
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, {lang: (*plan[lang], numbers) for lang, numbers in own.items()}, entries[0].view(np.uint64), *entries[1:], floors))
        part = rows.where(F.col("lang").isin(sorted(own))).mapInArrow(_score_with(sent), "k1 long, k2 int, log_prob double, n long")
        part = checkpointed(part.groupBy("k1", "k2").agg(F.first("log_prob").alias("log_prob"), F.first("n").alias("n")).withColumn("pass", F.lit(number)))
        found = part if found is None else found.union(part)
        sent.destroy()
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_scored", "log_prob")]
    if found is None:
        return docs.select(*names, F.lit(None).cast("long").alias("n_scored"), F.lit(None).cast("double").alias("log_prob"))
    sums = found.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.sum("n").alias("_n"), F.sum("log_prob").alias("_sum"))
    joined = docs.select(*names, keys["k1"].alias("_own_k1"), keys["k2"].alias("_own_k2")).join(sums, (F.col("_own_k1") == F.col("_k1")) & (F.col("_own_k2") == F.col("_k2")), "left")
    known = F.col(lang_col).isin(sorted(floors))  # a null text of a known language has no characters
    return joined.select(*names, F.when(known, F.coalesce("_n", F.lit(0))).alias("n_scored"), F.when(known, F.coalesce("_sum", F.lit(0.0))).alias("log_prob"))


_shards: dict[str, Shard] = {}


def _shard(sent) -> Shard:
    name, *packed = sent.value
    if name not in _shards:
        _shards.clear()
        _shards[name] = Shard(*packed)
    return _shards[name]


def _score_with(sent):
    def run(batches):
        shard = _shard(sent)
        for batch in batches:
            total, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                windows = [_windows(batch.column(1)[i].as_py()) for i in rows.tolist()]
                for grams, owner in _chunks(windows):
                    mine = shard.mine(lang, grams)
                    total += np.bincount(rows[owner[mine]], shard.score(lang, grams[mine]), minlength=len(batch))
                    n += np.bincount(rows[owner[mine]], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(total), pa.array(n)], ["k1", "k2", "log_prob", "n"])

    return run


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """docs with ``perplexity`` (per character), its language's ``threshold``, and ``keep``.

    trusted holds ids of trusted documents. Four in five of them (by crc32 of
    the id) train the language's model; the others' perplexities set its
    threshold. Texts without characters have no perplexity and are not kept;
    languages without a model or without held-out trusted documents have null
    figures and their documents are kept: nothing speaks against them. Null ids
    are never trusted; repeated rows get equal answers; no rows give no rows.
    Columns of docs that are named like the results give way to them.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("perplexity", "threshold", "keep")]
    ids = trusted.select(F.col(id_col).alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    kept = {c: f"_{i}_of_docs" for i, c in enumerate(names)}  # apart, so that texts nobody asks for aren't shuffled, and no name clashes
    own = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chosen = own.select("id", "text", "lang").join(ids, F.col("id") == F.col("_trusted"), "left_semi")
    held = F.crc32(F.col("id").cast("string")) % HELD_OUT == 0
    model = checkpointed(train(chosen.where(~held)))
    blank = F.coalesce(F.length(F.btrim("text")), F.lit(0)) == 0
    scored = score(own.withColumn("blank", blank), model, shard_entries=shard_entries)
    scored = scored.withColumn("perplexity", F.when(F.col("n_scored") > 0, F.exp(-F.col("log_prob") / F.col("n_scored"))))
    known = scored.where(held).join(ids, F.col("id") == F.col("_trusted"), "left_semi").where("perplexity IS NOT NULL")
    thresholds = checkpointed(known.groupBy(F.col("lang").alias("_lang")).agg((F.percentile_approx("perplexity", quantile, ACCURACY) * slack).alias("threshold")))
    bounded = scored.join(F.broadcast(thresholds), F.col("lang") == F.col("_lang"), "left")  # one row for each language
    keep = ~F.col("blank") & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return bounded.select(*[F.col(k).alias(c) for c, k in kept.items()], "perplexity", "threshold", keep.alias("keep"))
