"""Hashes of small images that are arrays of numbers, as column functions: no shuffle, no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_basis(size: int, terms: int) -> list[list[float]]:
    """Row u holds cos(pi u (2 y + 1) / (2 size)) for each y."""
    return [[math.cos(math.pi * u * (2 * y + 1) / (2 * size)) for y in range(size)] for u in range(terms)]


def cosine_terms(image: Column, size: int, terms: int = 8) -> Column:
    """The first ``terms`` by ``terms`` of the cosine transform of an image of ``size`` by ``size``, row by row, as two matrix products."""
    basis = F.array(*[F.array(*map(F.lit, row)) for row in cosine_basis(size, terms)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    places = F.sequence(F.lit(0), F.lit(size - 1))
    column = lambda c: F.transform(places, lambda y: F.get(image, y * size + c).cast("double"))
    columns = F.transform(places, column)
    by_row = F.transform(basis, lambda u: F.transform(columns, lambda col: dot(u, col)))
    return F.flatten(F.transform(by_row, lambda row: F.transform(basis, lambda w: dot(row, w))))


def perceptual_hash(image: Column, size: int, terms: int = 8) -> Column:
    """One bit for each term but the first: whether it is above their upper median.  Null for images of another size, or with null or non-finite values."""
    rest = F.slice(cosine_terms(image, size, terms), 2, terms * terms - 1)
    whole = (F.size(image) == size * size) & F.forall(image, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # one array of bits from one evaluation of the terms
    bits = F.transform(F.array(rest), lambda c: F.transform(c, lambda t: t > F.get(F.array_sort(c), F.floor(F.size(c) / 2).cast("int"))))
    number = F.aggregate(F.reverse(F.element_at(bits, 1)), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
    return F.when(whole, number)
