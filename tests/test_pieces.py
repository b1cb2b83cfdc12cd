"""Workers that read bodies hold one piece of a batch, not all of it."""

import json
import tracemalloc

import pyarrow as pa

from hushlake.functions import rules as R
from hushlake.operators import bodies as B
from hushlake.operators import pieces as P


def body(n: int, chars: int = 0) -> str:
    return json.dumps({"messages": [{"role": "user", "content": f"{n} said 123-45-6789"}, {"role": "user", "content": "x" * chars}]})


def test_a_worker_holds_one_piece():
    leaf = pa.list_(pa.struct([("field", pa.string()), ("text", pa.string())]))
    peaks = []
    for rows in (1_000, 8_000):
        batch = pa.array([body(n, 6_000) for n in range(rows)])
        tracemalloc.start()
        got = sum(len(piece) for piece in P.in_pieces(B._leaves, leaf)(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got == rows
    assert peaks[1] < 8e6 and peaks[1] < 1.5 * peaks[0]  # the larger batch has 48 MB


def test_pieces_end_by_rows_or_characters():
    seen = []
    short, long = pa.array([None, *["a"] * (2 * P.ROWS)]), pa.array(["b" * P.CHARS, "c", "d" * P.CHARS])
    run = P.in_pieces(lambda x: (seen.append(x), x)[1], pa.string())
    out = run(iter([short, long, pa.array([], pa.string())]))
    assert len(next(out)) == P.ROWS == len(seen)
    rest = list(out)
    assert [len(p) for p in rest] == [P.ROWS, 1, 1, 2]
    assert seen == short.to_pylist() + long.to_pylist()
    both = P.in_pieces(lambda x, y: f"{x}{y}", pa.string())(iter([(pa.array(["a", "b"]), pa.array([[1], None]))]))
    assert [p.to_pylist() for p in both] == [["a[1]", "bNone"]]


def test_rows_of_several_pieces_keep_their_ids(spark):
    texts = [None if n % 7 == 0 else f"plain 123-45-6789 {n}" if n % 11 == 0 else body(n, 2 * P.CHARS if n == 300 else 5) for n in range(3 * P.ROWS + 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string").coalesce(1)
    leaves = {(r.id, r.pos): r.text for r in B.text_leaves(rows, ["id"]).collect()}
    assert leaves == {(n, k): x["text"] for n, t in enumerate(texts) for k, x in enumerate(B._leaves(t))}
    short = rows.where("length(body) < 1000 OR body IS NULL")
    out = {r.id: r.redacted_body for r in B.redact_bodies(short, R.builtin_rules(spark).where("rule_id LIKE '%ssn%'"), block=True).collect()}
    assert out == {n: (t or "").replace("123-45-6789", "[REDACTED]") for n, t in enumerate(texts) if n != 300 or t is None}
