from keysieve.functions.globs import path_matcher
from keysieve.sources.tree import select_tree


def test_manifest_of_a_tree_is_matched_once(spark, tmp_path):
    for name in ("a/x.go", "a/vendor/y.go", "b/z.min.js"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("k\n")
    chosen = select_tree(spark, [str(tmp_path / "t"), str(tmp_path / "t" / "a")], path_matcher())
    assert {(r.path, r.root_ord, r.excluded_by, r.status) for r in chosen.collect()} == {
        ("a/x.go", 0, None, "selected"), ("x.go", 1, None, "duplicate"), ("a/vendor", 0, "a/vendor", "excluded"),
        ("vendor", 1, "vendor", "excluded"), ("b/z.min.js", 0, "b/z.min.js", "excluded"),
    }
    text = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in text and "Window" not in text
