"""Scalar expressions of the evaluation engine; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first32(digest: Column) -> Column:
    """The first four bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def derive_seed(*parts: Column | str) -> Column:
    """A seed in [0, 2**32): sha256 of `length:part` of all parts joined by bars. The lengths keep different part lists apart."""
    texts = [col(p).cast("string") for p in parts]
    return first32(F.sha2(F.concat_ws("|", *[F.concat_ws(":", F.char_length(t).cast("string"), t) for t in texts]), 256))


def subject_seed(subject: Column | str) -> Column:
    return first32(F.sha2(col(subject).cast("string"), 256))


def session_seed(master: Column, subject_index: Column, n_sessions: int, session_index: Column, modality: str, label: Column, subject: Column | str) -> Column:
    return derive_seed(master * 1000 + subject_index * n_sessions + session_index, F.lit(modality), label, subject_seed(subject))


def domain_scale(domain: Column | str) -> Column:
    return F.when(col(domain) == "a", F.lit(1.0)).otherwise(F.lit(1.35))


def sample_id(modality: Column, attack: Column, counter: Column) -> Column:
    return F.format_string("%s-%s-%08d", modality, attack, counter)


def finite(x: Column | str) -> Column:
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_zero(x: Column | str) -> Column:
    """NaN, infinities and null become 0."""
    x = col(x)
    return F.when(finite(x), x).otherwise(F.lit(0.0))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, the default where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def duration_seconds(text: Column | str, default: float | None = None) -> Column:
    """Seconds of `Duration: h:m:s.f` in a probe's text; without one the default, or null."""
    pattern = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(col(text), pattern, i)
    found = F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))
    return found if default is None else F.coalesce(found, F.lit(default))


def frame_times(duration: Column, n: int) -> Column:
    """The middles of n equal stretches."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (i + F.lit(0.5)) / F.lit(n))


def square_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A square window around a box, moved into the picture: struct(left, top, side)."""
    side = F.least(F.greatest(w, h), width, height)
    left = F.greatest(F.lit(0), F.least(F.rint(x + w / F.lit(2.0) - side / F.lit(2.0)).cast("long"), width - side))
    top = F.greatest(F.lit(0), F.least(F.rint(y + h / F.lit(2.0) - side / F.lit(2.0)).cast("long"), height - side))
    return F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"), side.cast("long").alias("side"))


def split_sizes(n: Column, train: float, dev: float) -> Column:
    """Sizes by rounding half to even; test gets the rest."""
    a, b = F.bround(n * F.lit(train)).cast("long"), F.bround(n * F.lit(dev)).cast("long")
    return F.struct(a.alias("n_train"), b.alias("n_dev"), (n - a - b).cast("long").alias("n_test"))


def code_label(code: Column, classes: dict[int, str]) -> Column:
    """The class of a code; null for codes that are left out."""
    return F.create_map(*[F.lit(x) for k, v in classes.items() for x in (k, v)])[code]


def detection_rate(found: Column, all_: Column) -> Column:
    """Rows found of all rows; 0 without any."""
    return ratio(F.sum(found.cast("long")), F.sum(all_.cast("long")))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; 0 with fewer than two rows or without variance, where corr() fails. A column of equal numbers has none, although its moments may have some of 1e-17 where a task spills and parts of a group are joined."""
    x, y = col(x), col(y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.coalesce(F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))), F.lit(0.0))
