"""What surrounds a recogniser, against plain Python."""

import random

import pytest

from paperloom.operators import recognition as rc


def chained(lines, expand=0.05, least=0.015, same_row=0.8, alone=0.5):
    """Runs of one block's lines ``(line_no, x0, y0, x1, y1)``."""
    own = [l for l in sorted(lines) if (l[3] - l[1]) * 5 > l[4] - l[2]]
    wide = [(x0 - (x1 - x0) * expand, y0, x1 + (x1 - x0) * expand, y1) for _, x0, y0, x1, y1 in own]
    area = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    runs, run = [], []
    for i, line in enumerate(own):
        shared = [0 if j in (i, i + 1) else area(wide[i], wide[j]) for j in range(len(own))]
        if not run:
            run = [i]
            continue
        mine, first = sum(shared[m] for m in run), own[run[0]]
        row = max(0, min(first[4], line[4]) - max(first[2], line[2])) / max(1, line[4] - line[2])
        if mine / max(1, (line[3] - line[1]) * (line[4] - line[2])) >= least and row > same_row and mine / max(1, sum(shared)) > alone:
            run.append(i)
        else:
            runs.append(run)
            run = []
    return [(own[r[0]][0], own[k][0]) for r in [*runs, run] if len(r) > 1 for k in r]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_a_line_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    blocks = {}
    for k in range(400):
        x, y = rng.randrange(0, 200, 5), rng.randrange(0, 60, 10)
        blocks.setdefault((1, k % 2, k % 5), []).append((k, float(x), y + rng.choice([0.0, 0.0, 1.0]), float(x + rng.randrange(1, 40)), y + 10.0))
    rows = [(*b, *line) for b, lines in blocks.items() for line in lines]
    got = rc.merged_lines(spark.createDataFrame(rows, "doc_id long, page int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double"))
    want = sorted((*b, *pair) for b, lines in blocks.items() for pair in chained(lines))
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_mode_of_reading(spark):
    blocks = [(1, 0, 1, "Text", 10.0), (1, 0, 2, "Table", 10.0), (1, 0, 3, "Text", 60.0), (1, 0, 4, "Code", 10.0), (1, 1, 1, "Text", 10.0), (1, 0, 5, None, 5.0)]
    lines = [(1, 0, 1, 0), (1, 0, 2, 1), (1, 0, 2, 2), (1, 0, 3, 3), *[(1, 0, 4, 10 + k) for k in range(16)], (1, 1, 1, 40)]
    df = spark.createDataFrame([(*b, 100.0) for b in blocks], "doc_id long, page int, block_no int, kind string, height double, page_height double")
    shares = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6)], "doc_id long, page int, share double")
    got = rc.read_by_mode(df, spark.createDataFrame(lines, "doc_id long, page int, block_no int, line_no int"), shares).collect()
    assert {(r.page, r.block_no, r.line_no) for r in got} == {(0, 1, None), (0, 2, 1), (0, 2, 2), (0, 3, 3), *[(0, 4, 10 + k) for k in range(16)], (1, 1, 40)}


def test_long_tables_in_batches(spark):
    cells = spark.createDataFrame([(1, 10 * r, c) for r in range(7) for c in range(2)] + [(2, r, 0) for r in range(9)], "table_id long, row_id int, col_id int")
    batched = rc.row_batches(cells, size=3, most=8)
    assert {(r.row_id, r.batch) for r in batched.collect()} == {(10 * r, r // 3) for r in range(7)} and batched.filter("table_id = 2").isEmpty()
    back = spark.createDataFrame([(1, 0, r) for r in (1, 2, 3)] + [(1, 1, r) for r in (1, 2)] + [(1, 2, 1)], "table_id long, batch int, row_id int")
    want, shift = [], 0
    for batch in ((1, 2, 3), (1, 2), (1,)):
        own = [r + shift for r in batch]
        want += own
        shift += max(own)
    assert sorted(r.row_id for r in rc.batches_joined(back).collect()) == sorted(want)
