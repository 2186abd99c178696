import random

from loomlake.llm.common import new_path


def tables(spark):
    """A folder with documents and labels, and their rows."""
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(103 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.choice([10, 60, 400]))]
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1].split(" ")
            if rng.random() < 0.5:
                text[0] = "changed"
        bad = "idiot" in text or rng.random() < 0.25
        if bad and "idiot" not in text:
            text.insert(1, "idiot")
        elif rng.random() < 0.1:
            text.append("password=abcdef0123456789abcdef")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    folder = new_path(spark, "tables")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels
