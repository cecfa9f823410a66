"""Trees through Arrow's file systems, folders with many entries, and files read in ranges."""

import io
import os
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from keysieve.functions.globs import path_matcher
from keysieve.operators.detect import detect_texts
from keysieve.operators.files import SELECTED, coverage, scanned_texts
from keysieve.plans.scan import scan_tree
from keysieve.sources import stores
from keysieve.sources.tree import lines_before, list_tree, ranges_of, read_selected, read_tree, scan_root, select_tree

LETTERS = "QRSTUVWXYZABCDEFGH234567"


def key(n):
    return "AKIA" + "".join(random.Random(n).sample(LETTERS, 16))


@pytest.fixture
def store(monkeypatch):
    """The local file system behind an address of its own, reached through Arrow."""
    monkeypatch.setitem(stores.FILE_SYSTEMS, "shelf", lambda address: (fs.LocalFileSystem(), address.removeprefix("shelf:/")))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    files = {".env": key(1), "_private": key(2), ".hidden/x.txt": f"a\n{key(3)}\n", "empty": "", "src/app.go": key(4), "bin": "\x00" + key(5),
             ".git/config": key(6), "node_modules/p/a.js": key(7), "sub/vendor/b": key(8), "a b/ü.txt": key(9)}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def statuses(files):
    return sorted((r.path, r.folder, r.size, r.status, bytes(r.content) if r.content is not None else None) for r in files.collect())


def test_a_store_gives_the_rows_of_the_mounted_tree(spark, rules, store, tree):
    mounted = read_tree(spark, [tree], path_matcher(), skip_binary=True)
    addressed = read_tree(spark, [f"shelf:/{tree}"], path_matcher(), skip_binary=True)
    assert statuses(addressed) == statuses(mounted)
    one, other = (scan_tree(spark, [root], rules) for root in (tree, f"shelf:/{tree}/"))
    assert sorted(map(repr, other.displayed.collect())) == sorted(map(repr, one.displayed.collect()))
    assert other.summary.first() == one.summary.first() and one.summary.first().finding_count == 6
    (named,) = read_tree(spark, [f"shelf:/{tree}/.env"], path_matcher()).collect()
    assert (named.path, bytes(named.content).decode()) == (".env", key(1))


def test_ignore_file_and_missing_roots_in_a_store(spark, rules, store, tree):
    with open(f"{tree}/.keysieveignore", "w") as file:
        file.write("src/**\n")
    assert scan_root([f"shelf:/{tree}/src/app.go"]) == f"shelf:/{tree}/src"
    found = scan_tree(spark, [f"shelf:/{tree}"], rules).displayed.collect()
    assert "src/app.go" not in {r.file for r in found} and len(found) == 5
    with pytest.raises(FileNotFoundError):
        read_tree(spark, [f"shelf:/{tree}/none"], path_matcher())


def test_files_that_vanish_from_a_store(spark, store, tree):
    chosen = select_tree(spark, [f"shelf:/{tree}"], path_matcher())
    os.remove(f"{tree}/.env")
    (lost,) = read_selected(chosen).filter("status = 'unreadable'").collect()
    assert lost.path == ".env" and lost.error


@pytest.mark.parametrize("scheme", ["", "shelf:/"])
def test_a_large_folder_is_asked_for_by_many_tasks(spark, store, tmp_path, scheme):
    folder = tmp_path / "wide"
    folder.mkdir()
    names = [f"{'.' if n % 3 == 0 else ''}f{n}" for n in range(20_000)]
    for n, name in enumerate(names):
        with open(folder / name, "w") as file:
            file.write("x" * (n % 5))
    entries = list_tree(spark, [f"{scheme}{folder}"], path_matcher((), defaults=False))
    rows = entries.select("path", "size", F.input_file_name().alias("part")).collect()
    assert sorted((r.path, r.size) for r in rows) == sorted((name, n % 5) for n, name in enumerate(names))
    assert len({r.part for r in rows}) > 1


def test_lines_of_ranges():
    dice = random.Random(3)
    for _ in range(300):
        data = b"".join(dice.choice([b"\n", b"\n", b"a", b"bb\n", b"c" * 20, b"\r\n"]) for _ in range(dice.randrange(0, 20)))
        step = dice.randrange(1, 15)
        cuts = list(range(0, max(len(data), 1), step))
        parts = [stores.read_lines_of(io.BytesIO(data), a, a + step if a != cuts[-1] else None) for a in cuts]
        assert b"".join(parts) == data
        assert all(p.endswith(b"\n") for p in [p for p in parts if p][:-1])
        assert stores.after_newline(io.BytesIO(data), 0, step=2) == (data.find(b"\n") + 1 or len(data))


def contents(seed):
    dice = random.Random(seed)
    lines = [f"k {key(seed * 1000 + n)}" if n % 17 == 0 else dice.choice(["", "plain", "é" * 30, "long " * 40, "cr\r"]) for n in range(400)]
    return "\n".join(lines) + ("\n" if seed % 2 else "")


@pytest.mark.parametrize("scheme", ["", "shelf:/"])
def test_large_files_in_ranges(spark, rules, store, tmp_path, scheme):
    """The same findings, line numbers and counters as of files read whole."""
    root = tmp_path / "big"
    (root / "sub").mkdir(parents=True)
    for n in range(4):
        (root / "sub" / f"f{n}.txt").write_bytes(contents(n).encode() + (b"\xff" if n == 2 else b""))
    (root / "one_line").write_text("x" * 9000 + " " + key(77) + " y" * 3000)
    (root / "small").write_text(key(78))
    (root / "bin").write_bytes(b"\x00" + b"z" * 5000)
    address = f"{scheme}{root}"
    whole = scan_tree(spark, [address], rules, skip_binary=True)
    cut = scan_tree(spark, [address], rules, skip_binary=True, range_bytes=700)
    assert sorted(map(repr, cut.displayed.collect())) == sorted(map(repr, whole.displayed.collect()))
    assert cut.summary.first() == whole.summary.first() and whole.summary.first().finding_count == 98
    assert cut.findings.columns == whole.findings.columns
    named = select_tree(spark, [address], path_matcher())
    pieces = read_selected(named, range_bytes=700).filter("path LIKE 'sub/%'")
    assert pieces.count() > 40 and pieces.select(F.max(F.length("content"))).first()[0] < 1500
    before = {(os.path.basename(r.abs_path), r.range_no): r.lines_before for r in lines_before(named, 700).collect()}
    text = contents(1).encode()
    assert all(n == text[: len(text) if r * 700 > len(text) else text.find(b"\n", r * 700 - 1) + 1].count(b"\n")
               for (name, r), n in before.items() if name == "f1.txt")


def test_unreadable_ranges_count(spark, rules, tmp_path):
    path = tmp_path / "r" / "f"
    path.parent.mkdir()
    path.write_text("a\n" * 1000)
    chosen = select_tree(spark, [str(tmp_path / "r")], path_matcher())
    os.remove(path)
    files = read_selected(chosen, range_bytes=500)
    row = coverage(files).first()
    assert (row.files_scanned, row.files_unreadable) == (0, 4)


def test_ranges_of_small_empty_and_unselected_files(spark):
    frame = spark.createDataFrame([("a", 0, SELECTED), ("b", 10, SELECTED), ("c", 11, SELECTED), ("d", 99, "excluded"), ("e", None, SELECTED)],
                                  "path string, size long, status string")
    got = [(r.path, r.range_no, r.range_start, r.range_end) for r in ranges_of(frame, 10).orderBy("path", "range_no").collect()]
    assert got == [("a", 0, 0, None), ("b", 0, 0, None), ("c", 0, 0, 10), ("c", 1, 10, None), ("d", 0, 0, None), ("e", 0, 0, None)]
    assert ranges_of(frame, None).count() == 5


def test_texts_of_ranges_carry_their_place(spark, rules):
    frame = spark.createDataFrame([("p", "/p", 1, "scanned", bytearray(b"k " + key(1).encode()))],
                                  "path string, abs_path string, range_no long, status string, content binary")
    found = detect_texts(scanned_texts(frame), rules, keep=("abs_path", "range_no"))
    assert [(r.line, r.abs_path, r.range_no) for r in found.collect()] == [(1, "/p", 1)]
