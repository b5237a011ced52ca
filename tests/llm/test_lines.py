"""Line dedup against brute force over pairs of lines, and against SQL."""

import re

import duckdb
import pytest

from topicloom.llm import queries as Q
from topicloom.llm.line_dedup import MIN_WORDS, deduplicated, drop_repeated_lines

from .common import docs_of, odd_rows

WHITE = " \t\r\x0b\x0c"
LAST = 1 << 62


def words_of(line):
    line = line.strip(WHITE).lower()
    return re.split("[ \t\r\x0b\x0c]+", line) if line else []


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < MIN_WORDS:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def by_brute_force(rows):
    """(doc_id, n_lines, n_kept, text) for rows whose (doc_id, text) are distinct."""
    lines = sorted((LAST if i is None else i, pos, words_of(line)) for i, t in set(rows) if t is not None for pos, line in enumerate(t.split("\n")))
    lines = [x for x in lines if x[2]]
    seen, gone, by_size = set(), set(), {}
    for i, pos, words in lines:
        if tuple(words) in seen or any(one_edit(words, other) for n in (len(words) - 1, len(words), len(words) + 1) for other in by_size.get(n, ())):
            gone.add((i, pos))
        if tuple(words) not in seen:
            seen.add(tuple(words))
            by_size.setdefault(len(words), []).append(words)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        split = t.split("\n")
        kept = [(pos, line) for pos, line in enumerate(split) if (LAST if i is None else i, pos) not in gone]
        out.append((i, sum(bool(words_of(x)) for x in split), sum(bool(words_of(x)) for _, x in kept), "\n".join(x for _, x in kept)))
    return sorted(out, key=key)


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_kept, r.text) for r in df.collect()), key=key)


BASE = "the quick brown fox jumps over the lazy dog today"
CASES = [
    (1, f"{BASE}\nshort line here\n\n  \n{BASE.upper()}\nunique words in a line that no other line has at all"),
    (2, BASE.replace("quick ", "")),
    (3, BASE.replace("quick", "slow")),
    (4, BASE + " again"),
    (5, "again " + BASE),
    (6, BASE.replace("quick", "slow").replace("lazy", "busy")),
    (7, "short line there\nshort line here\n\n"),
    (8, "one two three four five six seven\none two three four five six seven eight\none two three four five six eight"),
    (9, "a b a b a b a b\nb a b a b a b a\na b a b a b a b a"),
    (10, "\t" + BASE.replace(" ", "  \t") + "\r"),
    (None, BASE + "\nonly here without an id among all of the others"),
    (11, "\n"),
    (12, "Ärger über Öl im Fluß macht viele Menschen sehr wütend\nÄRGER ÜBER ÖL IM fluß MACHT VIELE MENSCHEN SEHR WÜTEND"),
]


def test_cases(spark):
    result = found(deduplicated(docs_of(spark, CASES)))
    assert result == by_brute_force(CASES)
    texts = {r[0]: r[3] for r in result}
    assert texts[2] == texts[3] == texts[4] == texts[5] == texts[10] == ""
    assert texts[7] == "short line there\n\n"
    assert texts[8].split("\n") == ["one two three four five six seven"]


def test_order_of_rows_does_not_matter(spark):
    assert found(deduplicated(docs_of(spark, CASES[::-1]))) == by_brute_force(CASES)


def test_odd_rows(spark):
    rows = [r for r in odd_rows(long_words=3000) if r[0] != 1000 or r[1] is not None]
    expected = by_brute_force(rows)
    assert found(deduplicated(docs_of(spark, rows))) == expected
    docs = docs_of(spark, rows)
    left = drop_repeated_lines(docs)
    assert left.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted(((i, t) for i, _, _, t in expected), key=key)
    assert all(r[c] == c.upper() for r in left.collect() for c in docs.columns[2:])


def test_a_line_that_many_have(spark):
    rows = [(k, f"{BASE}\nline {k} of this text has its own words w{k} v{k} u{k}") for k in range(300)]
    result = found(deduplicated(docs_of(spark, rows)))
    assert result == by_brute_force(rows)
    assert sum(n for _, _, n, _ in result) == 301


def test_nothing(spark):
    assert deduplicated(docs_of(spark, [])).collect() == []
    assert drop_repeated_lines(docs_of(spark, [])).collect() == []


def test_documents(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert found(Q.op3_line_dedup(spark, small)) == by_brute_force(docs)


def test_no_python_in_the_plan(spark, small):
    plan = Q.op3_line_dedup(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, medium, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{medium}/{table}.parquet'")
    df = Q.queries()[name](spark, medium)
    result = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(result.fetchall(), key=key)
