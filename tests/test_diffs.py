import random

from reviewlake.operators import diffs as dif


def frame(spark, *raws):
    return spark.createDataFrame([("r", i, raw) for i, raw in enumerate(raws)], "repo_full_name string, pr_number bigint, raw string")


MODIFIED = """warming up
diff --git a/x/a.go b/x/a.go
index 1..2 100644
--- a/x/a.go
+++ b/x/a.go
@@ -3,3 +3,4 @@ func f() {
 keep
-old
+new
+more
 tail

\\ No newline at end of file
@@ -20 +21 @@
-gone
+--back
---dashes
diff --git a/n.JS b/n.JS
new file mode 100644
--- /dev/null
+++ b/n.JS
@@ -0,0 +1,2 @@
+one
+two
diff --git a/d.py b/d.py
deleted file mode 100644
--- a/d.py
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/old.rs b/new.rs
similarity index 90%
rename from old.rs
rename to new.rs
--- a/old.rs
+++ b/new.rs
@@ bad header @@
?odd
diff --git a/pic.png b/pic.png
Binary files a/pic.png and b/pic.png differ
"""


def test_files(spark):
    rows = dif.diff_files(frame(spark, MODIFIED)).orderBy("file_idx").collect()
    assert [tuple(r)[2:] for r in rows] == [
        (0, "x/a.go", "---dashes", "go", False, False),
        (1, "n.JS", "", "javascript", True, False),
        (2, "d.py", "d.py", "", False, True),
        (3, "new.rs", "old.rs", "rust", False, False),
        (4, "", "", "", False, False),
    ]


def test_lines(spark):
    rows = dif.diff_lines(frame(spark, MODIFIED)).orderBy("file_idx", "diff_pos").collect()
    got = [(r.file_idx, r.hunk_idx, r.line_type[0], r.content, r.old_line, r.new_line, r.diff_pos) for r in rows]
    assert got == [
        (0, 0, "c", "keep", 3, 3, 2),
        (0, 0, "r", "old", 4, 0, 3),
        (0, 0, "a", "new", 0, 4, 4),
        (0, 0, "a", "more", 0, 5, 5),
        (0, 0, "c", "tail", 5, 6, 6),
        (0, 1, "r", "gone", 20, 0, 8),
        (0, 1, "a", "--back", 0, 21, 9),
        (1, 0, "a", "one", 0, 1, 2),
        (1, 0, "a", "two", 0, 2, 3),
        (2, 0, "r", "bye", 1, 0, 2),
        (3, 0, "c", "odd", 0, 0, 2),
    ]
    assert (rows[0].old_start, rows[0].old_lines, rows[0].new_start, rows[0].new_lines) == (3, 3, 3, 4)
    assert (rows[5].old_lines, rows[5].new_lines) == (1, 1)


def test_sets_and_summary(spark):
    diffs = frame(spark, MODIFIED, "")
    lines = dif.diff_lines(diffs)
    assert sorted((r.file_idx, r.line) for r in dif.changed_lines(lines).collect()) == [
        (0, 4), (0, 5), (0, 21), (1, 1), (1, 2)
    ]
    summary = {r.file_idx: (r.hunks, r.added) for r in dif.diff_summary(diffs).collect()}
    assert summary == {0: (2, 3), 1: (1, 2), 2: (1, 0), 3: (1, 0), 4: (0, 0)}


def test_last_position_wins(spark):
    raw = "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n+x\n@@ -1 +1 @@\n y\n"
    lines = dif.diff_lines(frame(spark, raw))
    assert [(r.line, r.diff_pos) for r in dif.line_positions(lines).collect()] == [(1, 4)]
    row = dif.line_info(lines).first()
    assert (row.diff_pos, row.changed) == (4, True)


def reference_lines(raw):
    """Plain loop over one diff, to compare the windows with."""
    out, file_idx, started, pos, old, new = [], -1, False, 0, 0, 0
    for text in raw.split("\n"):
        if text.startswith("diff --git "):
            file_idx, started, pos = file_idx + 1, False, 0
        elif file_idx < 0 or text.startswith(("---", "+++", "new file mode")):
            continue
        elif text.startswith("@@ "):
            spans = text[3:].split(" @@")[0].split()
            old, new = (int(s[1:].split(",")[0]) for s in spans)
            started, pos = True, pos + 1
        elif started and text and text != "\\ No newline at end of file":
            pos += 1
            minus, plus = text[0] == "-", text[0] == "+"
            out.append((file_idx, text[1:], 0 if plus else old, 0 if minus else new, pos))
            old += not plus
            new += not minus
    return out


def test_random_diffs_match_a_loop(spark):
    rng = random.Random(5)
    raws = []
    for _ in range(60):
        parts = []
        for f in range(rng.randint(1, 4)):
            parts.append(f"diff --git a/f{f} b/f{f}")
            for _ in range(rng.randint(0, 4)):
                parts.append(f"@@ -{rng.randint(1, 90)},{rng.randint(1, 9)} +{rng.randint(1, 90)} @@ x")
                parts += [rng.choice(["+", "-", " ", "--", "++", "---", "", "?", "+\r"]) + rng.choice(["", "a", "b c"]) for _ in range(rng.randint(0, 12))]
        raws.append("\n".join(parts))
    rows = dif.diff_lines(frame(spark, *raws)).orderBy("pr_number", "file_idx", "diff_pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.pr_number, []).append((r.file_idx, r.content, r.old_line, r.new_line, r.diff_pos))
    for i, raw in enumerate(raws):
        assert got.get(i, []) == reference_lines(raw), raw


def test_raw_text_is_shuffled_once(spark):
    plan = dif.changed_lines(dif.diff_lines(frame(spark, MODIFIED)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_oversized(spark):
    small, large = dif.split_oversized(frame(spark, "abc", "x" * 50), 10)
    assert (small.count(), large.count()) == (1, 1)
