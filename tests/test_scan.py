import random

from pyspark.sql import functions as F

from lodestone.functions import scan
from lodestone.operators import risk, text


def test_carried_over_ranges(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    ranged = scan.in_ranges(rows.repartition(9), "id")
    assert ranged.select(scan.RANGE).distinct().count() > 1
    before, reaches = scan.carried(ranged, F.sum("v"), 5, lambda now, own: now + own, "long")
    total = F.sum("v").over(scan.within_range("id"))
    got = {r.id: r.t for r in ranged.select("id", (before + total).alias("t")).collect()}
    want, now = {}, 5
    for i in range(1000):
        want[i] = now = now + i % 7
    assert got == want and min(reaches.values()) == 5
    none, reaches = scan.carried(scan.in_ranges(rows.limit(0), "id"), F.sum("v"), 5, lambda now, own: now + own, "long")
    assert reaches == {} and spark.range(1).select(none.alias("x")).first().x == 5


def hits(lines, words, strict):
    out, file = {}, None
    for line in lines:
        if line.startswith("+++ b/"):
            file = line[6:].strip()
        elif strict and line.startswith("+++ "):
            file = ""
        elif line[:1] in ("+", "-") and not line.startswith(("+++", "---")) and file:
            n = sum(w in line.lower() for w in words)
            if n:
                out[file] = out.get(file, 0) + n
    return out


def test_diff_over_ranges(spark):
    """Files whose lines go over many ranges, lines before any file, and files that are deleted."""
    rng = random.Random(2)
    lines = ["+token before", "-x"]
    for i in range(40):
        lines += [rng.choice([f"+++ b/f{i % 9}.py", "+++ /dev/null", f"+++ b/f{i}.py "])]
        lines += [rng.choice("+- ") + rng.choice(["token", "a SECRET token", "none", "++", "--x"]) for _ in range(rng.choice([0, 3, 300]))]
    frame = spark.createDataFrame(list(enumerate(lines)), "ord long, line string").repartition(7)
    for strict in (False, True):
        got = risk.security_hits(frame, strict=strict)
        assert {r.file_path: r.security_hits for r in got.collect()} == hits(lines, risk.SECURITY_WORDS, strict)
        assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert risk.security_hits(frame.limit(0)).count() == 0


def test_prompt_over_ranges(spark):
    rng = random.Random(3)
    files = [(f"p{i:03}", "full" if i % 3 else "summary", "é" * rng.randrange(60), "s" * rng.randrange(9)) for i in range(200)]
    frame = spark.createDataFrame(files, "path string, mode string, content string, summary string").repartition(6)
    for header, most in (("h" * 10, 3000), ("h" * 10, 0), ("h" * 5000, 100), ("", 10**6), ("", 57)):
        want, start = [], len(header)
        for path, mode, content, summary in files:
            block = f"### {path}\n{content if mode == 'full' else summary}\n\n"
            size = len(block.encode())
            if start > most and start != len(header):
                break
            shown = block if start + size <= most else block.encode()[: max(most - start, 0)].decode(errors="ignore") + text.TRUNCATED
            want.append((path, shown, start))
            start += size
            if start > most:
                break
        got = text.prompt_blocks(frame, header, most)
        assert sorted(map(tuple, got.collect())) == want, (header[:2], most)
        assert "SinglePartition" not in got._jdf.queryExecution().toString()
