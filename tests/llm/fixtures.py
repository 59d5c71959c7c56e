"""A small table with every awkward row: nulls, empties, long texts, copies, repeats, clashing columns."""

from __future__ import annotations

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, record string, key string, size long"


def documents(n: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Été", "straße", "house", "the", "of", "and", "river", "CC", "by", "年"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if i % 9 == 0:
            text = passage + "\n" + text
        if i % 11 == 0:
            text = "The " * 150 + text
        if i % 13 == 0:
            text += "\nReleased under the MIT License.\nAll rights reserved."
        rows.append([i, text, ["en", "fr", None][i % 3], ["s1", "s0", None, "hot", "hot", "hot"][i % 6]])
    rows[7][1] = rows[3][1]  # copies
    rows[8][1] = rows[3][1] + " gamma"
    rows[10][1], rows[12][1], rows[14][1] = None, "", " \t\n"
    rows[20][0] = None
    rows[21][1] = "x" * 5000 + " " + "word " * 8000  # long
    rows[22][1] = "12 34 --- !!"  # no letter
    rows.append(list(rows[3]))  # repeated row
    rows.append(list(rows[10]))
    rows.append([3, "another text under an id that is taken", "en", "s1"])
    return [(*r, None if r[1] is None else len(r[1]), 99, "clash", "k", -1) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC)


def table_dir(spark, path, rows=None, vectors=None, labels=None) -> str:
    """A folder with documents, embeddings and labels in the layout of the tables."""
    frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(vectors or [], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)
