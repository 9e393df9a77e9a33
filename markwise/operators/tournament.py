"""Cluster representatives: rounds of ten, the most central sentence goes on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise import fixed_values as fixed
from markwise.operators.alignment import _vectors
from markwise.operators.assignment import alignment_scores
from markwise.operators.embedding import known_words
from markwise.operators.skew import rank_rows, salted_join
from markwise.session import written


def _winner(tokens: list[list[str]], known: list[list[str]], units: list[np.ndarray]) -> int:
    """Index of the sentence with the highest length-weighted alignment, both
    ways, with the others of its batch; the first of equals."""
    sets = [set(t) for t in tokens]
    places = [{w: k for k, w in enumerate(words)} for words in known]
    score = np.zeros(len(tokens))
    pairs = [(i, j) for i in range(len(tokens)) for j in range(i + 1, len(tokens)) if tokens[i] != tokens[j]]
    ways = [way for i, j in pairs for way in ((i, j), (j, i))]
    aligned = iter(alignment_scores([(sets[i], sets[j], places[i], units[i], places[j], units[j]) for i, j in ways]))
    for i, j in pairs:
        total = len(tokens[i]) + len(tokens[j])
        forth, back = next(aligned), next(aligned)
        # an answer aligned with an ideal weighs by the answer's length
        both = (len(tokens[i]) * forth + len(tokens[j]) * back) / total
        score[i] += both
        score[j] += both
    return int(score.argmax())


def _play(keys: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            tokens, known = column["tokens"].to_pylist(), column["known"].to_pylist()
            vectors = column["vectors"].to_pylist()
            best = []
            for row in range(batch.num_rows):
                units = _vectors(pa.array(vectors[row], pa.list_(pa.float32())), width)
                best.append(_winner(tokens[row], known[row], units))
            yield pa.RecordBatch.from_arrays(
                [*[column[k] for k in keys], pa.array(best, pa.int32())], [*keys, "best"]
            )

    return run


def representatives(
    sentences: DataFrame,
    vocabulary: DataFrame,
    keys: list[str],
    width: int,
    batch: int = fixed.TOURNAMENT_BATCH,
) -> DataFrame:
    """(keys…, id, tokens) of the winner of each cluster.

    ``sentences``: (keys…, place, id, tokens), (place, id) being the order
    within a cluster. Only sentences under 20 tokens play, and clusters with
    fewer than 5 of them have no representative. A batch is ten sentences, so
    a cluster of any size is spread over all tasks; the rounds number the
    logarithm (base ten) of the largest cluster.
    """
    short = sentences.filter(F.size("tokens") < fixed.REPRESENTATIVE_MAX_TOKENS)
    counts = short.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    playing = counts.filter(F.col("n") >= fixed.REPRESENTATIVE_MIN_SENTENCES)
    short = salted_join(short, playing.select(*keys), keys, "id", "left_semi")
    ranked = written(rank_rows(short.select(*keys, "place", "id", "tokens"), keys, ["place", "id"], "seat"), "seats")
    words = known_words(ranked.select(*keys, "seat", "tokens"), vocabulary, [*keys, "seat"])
    players = ranked.join(words, [*keys, "seat"])
    while True:
        players = written(players, "round")
        if players.filter("seat > 0").isEmpty():
            return players.select(*keys, "id", "tokens")
        table = players.withColumn("table", F.floor(F.col("seat") / batch))
        entry = F.struct("seat", "tokens", "known_words", "known_vectors", "place", "id")
        tables = table.groupBy(*keys, "table").agg(F.array_sort(F.collect_list(entry)).alias("e"))
        types = dict(tables.dtypes)
        schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "table"]) + ", best int"
        best = tables.select(
            *keys, "table",
            F.col("e.tokens").alias("tokens"), F.col("e.known_words").alias("known"), F.col("e.known_vectors").alias("vectors"),
        ).mapInArrow(_play([*keys, "table"], width), schema)
        players = table.join(best, [*keys, "table"]).filter(F.col("seat") % batch == F.col("best")).select(
            *keys, F.col("table").alias("seat"), "place", "id", "tokens", "known_words", "known_vectors"
        )


def archetypes(winners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, archetype_good, archetype_bad): the winners' sentences by cluster number.

    ``winners``: (keys…, label, cluster, tokens).
    """
    def of(label: str):
        entry = F.when(F.col("label") == label, F.struct("cluster", F.concat_ws(" ", "tokens").alias("sentence")))
        return F.array_sort(F.collect_list(entry))

    together = winners.groupBy(*keys).agg(of(fixed.GOOD).alias("g"), of(fixed.BAD).alias("b"))
    return together.select(
        *keys, F.col("g.sentence").alias("archetype_good"), F.col("b.sentence").alias("archetype_bad")
    )
