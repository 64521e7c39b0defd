"""The queries give their SQL's rows, on the smallest tables and on conversations with quotations."""

import duckdb
import pytest

from tidewave.llm import quotes
from tidewave.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cursor = c.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    rows = lambda columns, table: sorted(([r[columns.index(k)] for k in order] for r in table), key=repr)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def quoted(k):
    """A conversation with quotations of lines, of passages wrapped anew, of several levels, and of what nobody said."""
    long = "One two three four five six seven\neight nine ten eleven twelve\nthirteen fourteen."
    return [
        (k, 0, "user", f"First line {k}\nSecond line\n\nThird, é!"),
        (k, 1, "assistant", "> second LINE\nan answer"),
        (k, 2, "user", f"On Monday A wrote:\n>> Second line\n> an answer\r\nmore > text {k}\n\n"),
        (k, 3, "user", None),
        (k, 4, "user", "> third é\n> never there\n"),
        (k, 5, "user", f"> more > text {k}\n>\nend"),
        (k, 6, "assistant", f"{long}\n\nAnother paragraph {k}."),
        (k, 7, "user", "> One two three four five six seven eight\n> nine ten eleven twelve thirteen\n> fourteen.\n>\n> never said\nwrapped anew"),
        (k, 8, "assistant", f"> wrapped anew\n>> ONE two, three four five six seven eight nine ten\n>> eleven twelve thirteen fourteen\nIndeed\nSecond line"),
        (k, 9, "user", "> Second line\n> indeed"),
        (k, 9, "user", "the same turn twice"),
    ]


@pytest.mark.parametrize("turns", [1 << 12, 3])
def test_quotations(spark, tmp_path, monkeypatch, turns):
    monkeypatch.setattr(quotes, "TURNS", turns)
    rows = sum((quoted(k) for k in range(20)), []) + [(None, 1, "user", "> x"), (99, None, "user", "> x"), (98, 0, "user", "word " * 20000 + "\n" + "line\n" * 3000), (98, 1, "user", "> line\n" * 5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = QUERIES["op3_quotes"](spark, str(tmp_path))
    cursor = c.execute(SQL["op3_quotes"])
    names = [x[0] for x in cursor.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    found = df.collect()
    mine = sorted(([r[k] for k in order] for r in found), key=repr)
    assert mine == sorted(([r[names.index(k)] for k in order] for r in cursor.fetchall()), key=repr)
    assert sum(r.n_linked for r in found) >= 120
    by = {r.turn: r for r in found if r.conv_id == 3}
    assert (by[7].parent_turn, by[7].n_linked, by[7].n_quoted) == (6, 3, 5) and (by[8].parent_turn, by[8].root_turn, by[8].n_linked) == (7, 6, 3) and by[8].text == "Indeed\nSecond line"
    keys = [(r.conv_id, r.root_turn, r.depth, r.turn) for r in found if r.conv_id is not None and r.turn is not None]
    assert keys == sorted(keys)


def test_lines_of_small_hosts_as_in_sql(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    df = QUERIES["op1_line_dedup"](spark, data)
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows == sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op1_line_dedup']})").fetchall(), key=repr)
    assert sum(r[df.columns.index("n_dropped")] for r in rows) > 0
