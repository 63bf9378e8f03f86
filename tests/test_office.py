"""Sheets of turns: long conversations, gaps and missing ids."""

import pyarrow as pa

from loomdex.catalog import office


def test_sheets_of_turns(spark, monkeypatch):
    rows = [(1, t, "user", f"text {t}") for t in range(23)] + [(2, t, "user", "") for t in (-5, 3, 900)]
    rows += [(None, 7, "user", "lost"), (None, 70, "user", "lost")]
    sizes = []
    monkeypatch.setattr(office, "_made", lambda df, kind, make, made=office._made: (sizes.extend(len(r["body"]) for r in df.collect()), made(df, kind, make))[1])
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    small = office.sheets_of_turns(turns, 5).collect()
    # A header and five turns at most.
    assert max(sizes) <= 6
    whole = office.sheets_of_turns(turns, 10**6).collect()
    assert sorted(map(tuple, small), key=repr) == sorted(map(tuple, whole), key=repr) and len(small) == len(rows)
    assert sorted(r["part"] for r in small if r["doc_id"] == 1) == list(range(23))


def test_files_are_made_a_few_at_a_time():
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    n = 3 * office.FILES_AT_ONCE + 1
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(n)], "body": ["a\nb"] * n})
    made = list(office._made(Rows(), "docx", lambda text: text.encode())(iter([batch])))
    assert sum(b.num_rows for b in made) == n and max(b.num_rows for b in made) <= office.FILES_AT_ONCE
    assert made[0].to_pylist()[0] == {"doc_id": "0", "kind": "docx", "content": b"a\nb"}
