"""The engine's functions under names that SQL can use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeResult

from .align import INSERTIONS, align, classify, insertions


@udtf(returnType=INSERTIONS.elementType)
class ClassifyInsertions:
    """classify_insertions(reference, hypothesis, rules): a row for each inserted word.

    A lateral join takes no Arrow table function, so this one goes pair by pair; explode(insertions(reference, hypothesis))
    gives the same rows in Arrow batches.
    """

    def eval(self, ref: str, hyp: str, rules: str):
        for x in classify([ref], [hyp], rules)[0]:
            yield x["word"], x["place"], x["category"], x["context"]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def bootstrap_interval(unit: pd.Series, errors: pd.Series, words: pd.Series) -> list:
    """bootstrap_interval(unit, errors, words), an aggregate: [rate, low, high], the rate and its 95 % interval over 1,000 resamples.  A group
    is whole in one task here; bootstrap_intervals streams it, operators.resample.bootstrap_ci spreads it over tasks."""
    import numpy as np

    from ..operators.resample import weights

    total = np.zeros((2, 1000))
    for a in range(0, len(unit), 1024):
        part = slice(a, a + 1024)
        total += np.stack([errors[part], words[part]]).astype(float) @ weights([str(x) for x in unit[part]], 1000)
    x = total[0][total[1] > 0] / total[1][total[1] > 0]
    low, high = np.percentile(x, [2.5, 97.5]) if len(x) else (None, None)
    return [float(errors.sum() / words.sum()) if words.sum() else None, low, high]


@udtf
class PlanBatches:
    """plan_batches(TABLE(t) PARTITION BY bucket ORDER BY (duration, id), 'duration', budget, cap, padded): the table's columns and batch, from 0 in each
    partition.

    Each partition comes as a stream, of which only the open batch's size and cost are kept.  operators.planning.batch_plan
    fills the chunks of a partition side by side; here a partition is one task.
    """

    def __init__(self):
        self.batch, self.n, self.cost = 0, 0, 0.0

    @staticmethod
    def analyze(rows, duration, budget, cap, padded):
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = [f.name for f in rows.dataType.fields]
        if duration.value not in names or "batch" in names:
            raise ValueError(f"a table with {duration.value} and without batch is needed")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("batch", T.LongType())]))

    def eval(self, row, duration, budget, cap, padded):
        value = float(row[duration] or 0)
        cost = max(self.cost, value) if padded else self.cost + value
        if self.n and (self.n >= cap or ((self.n + 1) * cost if padded else cost) > float(budget) + 1e-9):
            self.batch, self.n, cost = self.batch + 1, 0, value
        self.n, self.cost = self.n + 1, cost
        yield (*row, self.batch)


class _Draws:
    """Weighted sums of a stream of rows, for each resample; rows are drawn for a thousand at a time."""

    def __init__(self, columns: int, resamples: int):
        import numpy as np

        self.sums, self.held, self.plain = np.zeros((columns, resamples), np.int64), [], [0] * columns

    def add(self, unit, *values) -> None:
        values = [int(v or 0) for v in values]
        self.plain = [a + b for a, b in zip(self.plain, values, strict=True)]
        self.held.append(("" if unit is None else str(unit), values))
        if len(self.held) == 1024:
            self.drawn()

    def drawn(self):
        """The sums so far."""
        import numpy as np

        from ..operators.resample import weights

        if self.held:
            values = np.array([v for _, v in self.held], np.float64).T
            self.sums += np.rint(values @ weights([u for u, _ in self.held], self.sums.shape[1])).astype(np.int64)
            self.held = []
        return self.sums


@udtf
class PairedBootstrapP:
    """paired_bootstrap_p(TABLE(SELECT key, unit, a, b, words ...) PARTITION BY key): a row of key, n, delta, low, high, p and p_two_sided for each key.

    The columns go by place.  A partition's rows are drawn as they come, so memory holds 10,000 sums, not the rows;
    operators.resample.paired_bootstrap gives the same figures with a key spread over many tasks.
    """

    def __init__(self):
        self.draws, self.key, self.n = _Draws(3, 10_000), None, 0

    @staticmethod
    def analyze(rows):
        fields = rows.dataType.fields if rows.isTable else []
        if len(fields) != 5:
            raise ValueError("a table of key, unit, a, b and words is needed")
        double = [T.StructField(c, T.DoubleType()) for c in ("delta", "low", "high", "p", "p_two_sided")]
        return AnalyzeResult(T.StructType([fields[0], T.StructField("n", T.LongType()), *double]))

    def eval(self, row):
        self.key, self.n = row[0], self.n + 1
        self.draws.add(*row[1:])

    def terminate(self):
        import numpy as np

        if not self.n:
            return
        (a, b, words), (one, two, all_words) = self.draws.drawn(), self.draws.plain
        x = (b - a)[words != 0] / words[words != 0]
        delta = (two - one) / all_words if all_words else None
        if not len(x):
            yield self.key, self.n, delta, None, None, None, None
            return
        up, down = float((x >= 0).mean()), float((x <= 0).mean())
        low, high = np.percentile(x, [2.5, 97.5]).tolist()
        yield self.key, self.n, delta, low, high, up, min(1.0, 2 * min(up, down))


@udtf
class BootstrapIntervals:
    """bootstrap_intervals(TABLE(SELECT key, unit, errors, words ...) PARTITION BY key): a row of key, n, rate, low and high for each key, of 1,000 resamples, in
    the memory of their sums; the columns go by place."""

    def __init__(self):
        self.draws, self.key, self.n = _Draws(2, 1000), None, 0

    @staticmethod
    def analyze(rows):
        fields = rows.dataType.fields if rows.isTable else []
        if len(fields) != 4:
            raise ValueError("a table of key, unit, errors and words is needed")
        return AnalyzeResult(T.StructType([fields[0], T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("rate", "low", "high"))]))

    def eval(self, row):
        self.key, self.n = row[0], self.n + 1
        self.draws.add(*row[1:])

    def terminate(self):
        import numpy as np

        if not self.n:
            return
        errors, words = self.draws.drawn()
        x = errors[words != 0] / words[words != 0]
        low, high = np.percentile(x, [2.5, 97.5]).tolist() if len(x) else (None, None)
        yield self.key, self.n, self.draws.plain[0] / self.draws.plain[1] if self.draws.plain[1] else None, low, high


def register(spark: SparkSession) -> None:
    """align_words, insertions (and _b, _c for the other rules), classify_insertions, bootstrap_interval, normalize_text, count_words,
    safe_label, edits_of_rate; of tables with PARTITION BY: plan_batches, paired_bootstrap_p, bootstrap_intervals."""
    spark.udf.register("align_words", align)
    for name, rules in (("insertions", "ngram"), ("insertions_b", "ngram_or_word"), ("insertions_c", "function_first")):
        spark.udf.register(name, insertions(rules))
    spark.udf.register("bootstrap_interval", bootstrap_interval)
    for name, function in (("classify_insertions", ClassifyInsertions), ("plan_batches", PlanBatches), ("paired_bootstrap_p", PairedBootstrapP), ("bootstrap_intervals", BootstrapIntervals)):
        spark.udtf.register(name, function)
    define = "CREATE OR REPLACE TEMPORARY FUNCTION "
    spark.sql(define + "normalize_text(x STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\\' ]+', ' '), ' +', ' '))")
    spark.sql(define + "count_words(x STRING) RETURNS BIGINT RETURN regexp_count(lower(x), '[a-z0-9\\']+')")
    spark.sql(define + "safe_label(x STRING) RETURNS STRING RETURN trim(BOTH '_' FROM regexp_replace(x, '[^A-Za-z0-9._-]+', '_'))")
    spark.sql(define + "edits_of_rate(rate DOUBLE, words BIGINT) RETURNS BIGINT RETURN CAST(bround(rate * words) AS BIGINT)")
