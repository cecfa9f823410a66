"""Tasks must not need the package on their own import path."""

import subprocess
import sys
import textwrap

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from keysieve.session import local_session
spark = local_session("2")
spark.sparkContext.setLogLevel("OFF")
from keysieve.functions.globs import path_matcher
from keysieve.operators.detect import detect
from keysieve.sources.rulesets import Rule, RuleSet
from keysieve.sources.tree import read_tree, write_tree
texts = spark.createDataFrame([("a/.env", "x"), ("b", "y")], "path string, text string")
write_tree(texts, {root!r})
files = read_tree(spark, [{root!r}], path_matcher())
lines = spark.createDataFrame([("p", 1, "ab c1")], "path string, line_no int, line string")
rules = RuleSet(rules=(Rule("n", "(?:a(b)|c)+", ("a",)), Rule("l", "c([0-9])", ("c",))), linear_rules=frozenset("l"))
print("RESULT", sorted(r.path for r in files.collect()), detect(lines, rules).count())
"""


TABLES = """
import sys
sys.path.insert(0, {repo!r})
from keysieve.session import local_session
spark = local_session("2")
spark.sparkContext.setLogLevel("OFF")
from keysieve.operators.ignores import ignore_patterns, with_ignored
from keysieve.operators.indexed import build_index, detect_indexed
from keysieve.plans.scan import scan_tree
from keysieve.sources.rulesets import Rule, RuleSet, rules_table
from keysieve.sources.tree import write_tree
from keysieve.streaming import exports
rules = RuleSet(rules=(Rule("n", "(?:a(b)|c)+", ("a",)), Rule("l", "c([0-9])", ("c",))))
lines = spark.createDataFrame([("p", 1, "ab c1")], "path string, line_no int, line string")
found = detect_indexed(lines, build_index(rules_table(spark, rules))).count()
texts = spark.createDataFrame([("a/.env", "c1 c2 c3 c4"), ("b", "x")], "path string, text string")
write_tree(texts, {root!r})
cut = scan_tree(spark, [{root!r}], rules, range_bytes=4).displayed.count()
patterns = ignore_patterns(spark.createDataFrame([("r", 0, "a/**")], "repo string, ordinal int, line string"))
ignored = with_ignored(texts.selectExpr("'r' AS repo", "path"), patterns).filter("excluded_by IS NOT NULL").count()
exports.register(spark)
open({root!r} + "/b", "w").write("commit " + "a" * 40 + "\\n\\ncommit " + "b" * 40 + "\\n")
commits = spark.read.format(exports.NAME).load({root!r} + "/b").count()
print("RESULT", found, cut, ignored, commits)
"""


def test_tables_and_sources_from_another_folder(tmp_path):
    import os

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(TABLES).format(repo=repo, root=str(tmp_path / "root"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "RESULT 3 4 1 2" in done.stdout, done.stdout + done.stderr[-2000:]


def test_from_another_folder(tmp_path):
    import os

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(SCRIPT).format(repo=repo, root=str(tmp_path / "root"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "RESULT ['a/.env', 'b'] 3" in done.stdout, done.stdout + done.stderr[-2000:]
