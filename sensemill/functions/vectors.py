"""Vector arithmetic as Column builders over array<double>; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_euclid(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a norm is 0."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def weighted_cosine(a: Column, b: Column, cut: int, size: int) -> Column:
    """Mean of the cosine distances of two modalities, cut at position ``cut`` of ``size``."""
    parts = ((1, cut), (cut + 1, size - cut))
    return sum((cosine_distance(F.slice(a, s, n), F.slice(b, s, n)) for s, n in parts), F.lit(0.0)) / 2


def unit(v: Column) -> Column:
    """v / |v|; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def gaussian_kl(m1: Column, v1: Column, m2: Column, v2: Column, literal: bool = False) -> Column:
    """KL divergence of diagonal Gaussians; ``literal`` counts trace - d once for each dimension."""
    logs = total(F.zip_with(v2, v1, lambda x, y: F.ln(x / y)))
    trace = total(F.zip_with(v1, v2, lambda x, y: x / y))
    shift = total(F.zip_with(F.zip_with(m2, m1, lambda x, y: (x - y) * (x - y)), v2, lambda x, y: x / y))
    d = F.size(v1).cast("double")
    return (logs + shift + (d if literal else F.lit(1.0)) * (trace - d)) / 2


def symmetric_kl(m1: Column, v1: Column, m2: Column, v2: Column, literal: bool = False) -> Column:
    return (gaussian_kl(m1, v1, m2, v2, literal) + gaussian_kl(m2, v2, m1, v1, literal)) / 2


def two_modality_kl(m1: Column, v1: Column, m2: Column, v2: Column, cut: int, size: int, literal: bool = False) -> Column:
    """Mean of the symmetric KL divergences of two modalities, cut at position ``cut`` of ``size``."""
    parts = ((1, cut), (cut + 1, size - cut))
    return sum((symmetric_kl(*(F.slice(x, s, n) for x in (m1, v1, m2, v2)), literal) for s, n in parts), F.lit(0.0)) / 2


def repeated(v: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(v, times))


#: Distances that can be chosen by name.
DISTANCES = {"cosine": cosine_distance, "sqeuclid": squared_euclid}


def fusion_redundancy(weight: float, big: int, small: int, clamp: bool = True) -> tuple[int, int]:
    """How often the image and the text vector are repeated so that ``weight`` is the image's share."""
    if weight == 0:
        return 0, 1
    if weight == 1:
        return 1, 0
    image_is_big = big >= small
    other, own = ((1 - weight), weight) if image_is_big else (weight, 1 - weight)
    times = int(max(big, small) * other / (min(big, small) * own) + 0.5)
    image, text = (1, times) if image_is_big else (times, 1)
    return image, max(1, text) if clamp else text


def estimated_k(n_clusters: int, senses_per_cluster: float = 1.78126117241) -> int:
    """Number of groups expected from so many clusters."""
    return int(n_clusters / senses_per_cluster + 0.5)
