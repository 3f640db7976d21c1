"""A synthetic set of utterances by category, the same for the same seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Templates of our own; {w} is a word, {n} a number.
TEMPLATES = {
    "basic": "please tell me about {w}",
    "numbers": "set a timer for {n} minutes",
    "names": "call {w} and then {w}",
    "commands": "turn {w} the lights",
    "questions": "what is the {w} of {w}",
    "dates": "remind me on day {n}",
    "long": "first {w} then {w} then {w} and after that {w}",
    "short": "{w}",
    "mixed": "order {n} {w} for {w}",
}
WORDS = "river window market garden letter winter copper signal harbor meadow".split()


def golden_set(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """n utterances of each category: id, category, text. Each category has a generator of its own, so adding one moves no other."""
    rows = []
    for category, template in sorted(TEMPLATES.items()):
        rng = random.Random(f"{seed}:{category}")
        for i in range(n):
            text = template
            while "{w}" in text or "{n}" in text:
                text = text.replace("{w}", rng.choice(WORDS), 1).replace("{n}", str(rng.randint(1, 60)), 1)
            rows.append((f"{category}-{i:04d}", category, text))
    return spark.createDataFrame(rows, "id string, category string, text string")
