import random
import re

import pytest

from tallyscan.llm.linededup import dedup_lines, without_repeats


def brute(rows, run, words=None):
    """Lines that lie in a run with an equal, earlier one; exact repeats of a row are one document. Shorter runs count with so many words."""
    import hashlib

    keyed = {(i is not None, i or 0, "" if t is None else hashlib.md5(t.encode()).hexdigest()): t for i, t in rows}
    seen, gone = set(), {}
    for key in sorted(keyed):
        text = keyed[key]
        if text is None:
            continue
        lines = text.split("\n")
        real = [n for n, line in enumerate(lines) if line.strip(" \t\r\f\x0b")]
        long = [len(re.split("[ \t\r\f\x0b]+", line.strip(" "))) for line in lines]
        for size in range(run if words is None else 1, run + 1):
            for s in range(len(real) - size + 1):
                at = real[s : s + size]
                if size < run and sum(long[n] for n in at) < words:
                    continue
                content = tuple(lines[n] for n in at)
                if content in seen:
                    gone.setdefault(key, set()).update(range(at[0], at[-1] + 1))
                seen.add(content)
    out = []
    for i, t in rows:
        bad = gone.get((i is not None, i or 0, "" if t is None else hashlib.md5(t.encode()).hexdigest()), set())
        kept = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in bad)
        out.append((i, kept, len(bad)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run,gram", [(3, 2), (1, 1), (4, 2), (5, 1)])
def test_against_brute_force(spark, run, gram):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "hot line", "é"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x\n" * 2000), (104, "long " * 30000), (None, "a\nb\nc\nb"), (3, "p\nq\nr\ns\nt"), (3, "p\nq\nr\ns\nt"), (3, "z\np\nq\nr\ns\nt")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, start int, lines string")
    done = without_repeats(df, run=run, gram=gram)
    assert done.columns[:4] == df.columns
    assert sorted(((r.doc_id, r._kept, r._removed) for r in done.collect()), key=str) == brute(rows, run)


@pytest.mark.parametrize("words", [2, 5, 50])
def test_short_runs_against_brute_force(spark, words):
    rng = random.Random(words)
    lines = ["a", "b c", "d  e\tf", "\tg h", " i j k l m", "", " ", "long " * 30]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 7)))) for i in range(80)] + [(90, None), (None, "b c\nb c"), (91, "long " * 30)]
    done = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=words)
    assert sorted(((r.doc_id, r._kept, r._removed) for r in done.collect()), key=str) == brute(rows, 3, words)


def test_documents_deleted_whole_go(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "\n"), (4, None), (5, "x\na\nb\nc")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, dedup_lines(df).collect())) == [(1, "a\nb\nc", 5), (3, "\n", 1), (4, None, None), (5, "x", 1)]
    assert dedup_lines(df.limit(0)).collect() == []


def test_long_runs_of_one_and_two_lines_go(spark):
    long, half, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25)), " ".join(f"k{i}" for i in range(25))
    short = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{long}\nx"), (2, long), (3, f"y\n{long}\nz"), (4, f"{half}\n\n{other}"), (5, f"p\n{half}\n{other}"), (6, half),
            (7, short), (8, short), (9, f"q\n{half} \n{other}"), (10, f"{long}\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, dedup_lines(df).collect())) == [
        rows[0], (3, "y\nz"), rows[3], (5, "p"), rows[5], rows[6], rows[7], rows[8]]
    assert sorted(map(tuple, dedup_lines(df, words=None).collect())) == rows
