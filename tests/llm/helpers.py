"""Small frames with the awkward rows that every operator must stand."""

LONG = " ".join(f"word{k} goes on" for k in range(9000))


def odd_docs(spark, *texts):
    """Given texts, then a null, an empty, a very long and a repeated one, a row without id, and clashing extra columns."""
    rows = [(k, t) for k, t in enumerate([*texts, None, "", LONG, "", "twice the same row", "twice the same row"])]
    rows += [rows[-1], (None, "no id at all here"), (0, "another text for id zero")]
    schema = "doc_id long, text string, score double, n_hit long, terms string, h long, node long, spans string, class_id long"
    return spark.createDataFrame([(i, t, 0.5, 1, "x", 2, 3, "y", 4) for i, t in rows], schema)


def nothing(spark):
    return odd_docs(spark).limit(0)
