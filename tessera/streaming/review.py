"""Spaced repetition: memory state of each card as an ordered fold over its reviews (FSRS-5, a published algorithm).

Reviews are dealt by card and sorted; a task keeps the state of one card at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The algorithm's default parameters, its forgetting curve, the aimed-at share remembered
# and the longest interval in days.
W = (0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621)
DECAY, FACTOR, AIM, LONGEST = -0.5, 19 / 81, 0.9, 36_500


def first_difficulty(rating: int) -> float:
    return min(10.0, max(1.0, W[4] - math.exp(W[5] * (rating - 1)) + 1))


def review(state: tuple[float, float] | None, rating: int, days: float) -> tuple[float, float]:
    """(stability, difficulty) after a review rated 1 to 4, so many days after the one before."""
    if state is None:
        return W[rating - 1], first_difficulty(rating)
    s, d = state
    if days < 1:
        new = s * math.exp(W[17] * (rating - 3 + W[18]))
    else:
        r = (1 + FACTOR * days / s) ** DECAY
        if rating == 1:
            new = min(s, W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(W[14] * (1 - r)))
        else:
            new = s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9] * (math.exp(W[10] * (1 - r)) - 1) * (W[15] if rating == 2 else 1) * (W[16] if rating == 4 else 1))
    step = d - W[6] * (rating - 3) * (10 - d) / 9
    return max(0.01, new), min(10.0, max(1.0, W[7] * first_difficulty(4) + (1 - W[7]) * step))


def interval(stability: float) -> int:
    return min(LONGEST, max(1, round(stability / FACTOR * (AIM ** (1 / DECAY) - 1))))


def fold(reviews: DataFrame) -> DataFrame:
    """Last state per card from reviews (card, at in seconds, rating): (card, n_reviews, lapses, stability, difficulty, interval_days)."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["card", "n_reviews", "lapses", "stability", "difficulty", "interval_days"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32()]
        done: list[tuple] = []
        now: list | None = None  # card, reviews, lapses, state, time

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for card, at, rating in zip(*(batch.column(c).to_pylist() for c in ("card", "at", "rating")), strict=True):
                if now is None or now[0] != card:
                    if now is not None:
                        done.append((now[0], now[1], now[2], *now[3], interval(now[3][0])))
                    now = [card, 0, 0, None, at]
                now[3] = review(now[3], rating, (at - now[4]) / 86400)
                now[1], now[2], now[4] = now[1] + 1, now[2] + (rating == 1), at
                if len(done) >= 10_000:
                    yield flush()
                    done.clear()
        if now is not None:
            done.append((now[0], now[1], now[2], *now[3], interval(now[3][0])))
        if done:
            yield flush()

    ordered = reviews.select("card", "at", "rating").repartition("card").sortWithinPartitions("card", "at", "rating")
    return ordered.mapInArrow(folded, "card long, n_reviews long, lapses long, stability double, difficulty double, interval_days int")
