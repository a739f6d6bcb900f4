from __future__ import annotations

import hashlib
import pickle
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossaspark.__main__ import main
from glossaspark.functions import paths
from glossaspark.sources import archives, compatibility, encoding, events, projects, publish, scripts, templates

SCRIPT = '''define aoi = Character("Aoi")
label start:
    aoi happy "Good [player_name]. {color=#f00}Hear it?{/color}"
    "Wind."
    menu:
        "Open the door":
            aoi "Cold!"
        "Wait" if brave("x"):
            "Nothing."
    $ x = "skipped"
    python:
        y = "skipped"
    voice "a.ogg"
    scene expression "bg"
    aoi """long
    text"""
    # "comment"
    return
"after"
'''


def parsed(spark, *texts, **settings):
    df = spark.createDataFrame([(f"{i}", t, "utf-8", "0" * 64) for i, t in enumerate(texts)], "path string, text string, encoding string, sha256 string")
    found = scripts.rows(df, **settings).select("source_file", "kind", "line_number", "scene", "speaker", "source_text")
    return sorted(map(tuple, found.collect()), key=lambda r: (int(r[0]), r[2], r[1]))


def test_extraction_rules(spark):
    every = [r[1:] for r in parsed(spark, SCRIPT)]
    rows = [r for r in every if r[0] != "character"]
    assert [r[0] for r in rows] == ["dialogue", "narration", "menu_choice", "dialogue", "menu_choice", "narration", "warning"]
    assert rows[0] == ("dialogue", 3, "start", "aoi", "Good [player_name]. {color=#f00}Hear it?{/color}")
    assert rows[4][4] == "Wait"
    assert [r for r in every if r[0] == "character"] == [("character", 1, "aoi", None, "Aoi")]


@pytest.mark.parametrize(
    ("script", "wanted"),
    [
        ('label a:\n  """x\nlabel b:\n  "t"\n', [("warning", 2, None), ("narration", 4, "b")]),  # a label ends an open quote
        ('label a:\n  python:\n    x\n    """y"""\n  "t"\n', [("warning", 4, None), ("narration", 5, "a")]),  # quotes warn inside blocks
        ('label a:\n    "t"\n  # c\n\n"u"\n    "v"\n', [("narration", 2, "a")]),  # comments close nothing, "u" closes the label
        ('label a:\n  menu:\n    "c":\n      "t"\n  "d":\n', [("menu_choice", 3, "a"), ("narration", 4, "a"), ("narration", 5, "a")]),
        ('label a:\n  python:\n    menu:\n      "c":\n  "d"\n', [("narration", 5, "a")]),
        ('label a:\n  show "x"\n  e "a" "b"\n  show "a" "b"\n  $ "q"\n', [("warning", 3, None)]),
        ('label .l.m(x, y=1): # c\n\t\u00e9va @happy "t"\n', [("dialogue", 2, ".l.m")]),
        ('"t"\n', []),
        ("", []),
    ],
)
def test_scopes(spark, script, wanted):
    assert [(r[1], r[2], r[3]) for r in parsed(spark, script)] == wanted


def test_ranges_of_any_size_give_the_same_rows(spark):
    """Random scripts, cut anywhere: inside of labels, blocks, menus and open quotes."""
    rng = random.Random(8)
    pieces = ["label a:", "label .b(x):", "menu:", "python:", "init python early:", '"Hi"', 'aoi "x"', '"Go":', '"Go" if x("1"):', "$ z", '"""', 'e """open', "\'\'\'", "# c", "", 'foo "a" "b"', 'define e = Character("E")']
    line = lambda: rng.choice(["", "    ", "        ", "\t", "            "]) + rng.choice(pieces)
    texts = ["label z:\n" + "\n".join(line() for _ in range(rng.randrange(80))) for _ in range(60)]
    whole = parsed(spark, *texts)
    assert len(whole) > 200
    for size in (1, 3, 16):
        assert parsed(spark, *texts, size=size) == whole


def test_one_script_is_the_work_of_many_ranges(spark):
    script = "label a:\n" + "".join(f'    "line {i}"\n' for i in range(50_000)) + "    menu:\n" + "".join(f'        "choice {i}":\n            "t"\n' for i in range(5000))
    rows = parsed(spark, script)
    assert [r[1] for r in rows].count("menu_choice") == 5000 and [r[1] for r in rows].count("narration") == 55_000
    df = spark.createDataFrame([("a", script, "utf-8", "0")], "path string, text string, encoding string, sha256 string")
    assert scripts._ranges(df, scripts.RANGE).count() == 15


@pytest.mark.parametrize(
    ("code", "wanted"),
    [
        ('a "x" # "y"', [(2, 5, "x")]),
        (r'"a\"b" \'', [(0, 6, r"a\"b")]),
        ('"open', []),
        ("'it' \"two\"", [(0, 4, "it"), (5, 10, "two")]),
        ('"#in"', [(0, 5, "#in")]),
    ],
)
def test_literals(spark, code, wanted):
    df = spark.createDataFrame([(code,), (None,)], "c string").select(scripts.string_literals(F.col("c")).alias("x"))
    assert sorted(([tuple(t) for t in r["x"]] if r["x"] is not None else None for r in df.collect()), key=lambda x: x is None) == [wanted, None]


def test_ids_follow_place_among_equals_and_not_lines(spark):
    def ids(text):
        df = spark.createDataFrame([("game/a.rpy", text, "utf-8", "0" * 64)], "path string, text string, encoding string, sha256 string")
        return [(r["line_number"], r["id"]) for r in scripts.segments(scripts.rows(df)).orderBy("line_number").collect()]

    text = 'label a:\n    "Same."\n    "Same."\n'
    one, two = ids(text), ids("\n\n" + text)
    assert [i for _, i in one] == [i for _, i in two] and [n for n, _ in one] != [n for n, _ in two]
    assert len({i for _, i in one}) == 2
    source = "\0".join(("game/a.rpy", "a", "narration", "", "Same.", "1"))
    assert one[1][1] == "seg_" + hashlib.sha256(source.encode()).hexdigest()[:24]


@pytest.mark.parametrize(
    ("data", "wanted"),
    [
        (b"", ("", "utf-8", False)),
        ("日本語".encode("cp932"), ("日本語", "cp932", False)),
        ("﻿hi".encode(), ("hi", "utf-8-sig", True)),
        (b"\xff\xfe" + "hi".encode("utf-16-le"), ("hi", "utf-16-le", True)),
        ("hello wörld".encode("utf-16-be"), ("hello wörld", "utf-16-be", False)),
        ("今天天气很好我们去公园吧".encode("gb18030"), None),
        (bytes(range(32)), None),
        (b"\xef\xbb\xbf\xff", None),
    ],
)
def test_encodings(data, wanted):
    found = encoding.decoded(data)
    if wanted is None and data[:1] == "今".encode("gb18030")[:1]:
        assert found is None or found[1] in ("cp932", "gb18030")  # both read some bytes
    else:
        assert found == wanted


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "my game"
    for path, data in {
        "game/script.rpy": SCRIPT.encode(),
        "game/chapter/one.rpym": "label one:\r\n    \"語\"\r\n".encode("cp932"),
        "game/.venv/ignored.rpy": b"label x:\n",
        "game/a+b%20c.txt": b"one\ntwo\n",
        "game/bad.txt": bytes(range(32)),
        "game/pic.png": b"\x89PNG",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    return root


def test_project_scan(spark, project):
    before = {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in project.rglob("*") if p.is_file()}
    good, bad = projects.scan(spark, str(project))
    rows = {r["path"]: r for r in good.collect()}
    assert set(rows) == {"game/script.rpy", "game/chapter/one.rpym", "game/a+b%20c.txt"}
    assert rows["game/chapter/one.rpym"]["encoding"] == "cp932" and rows["game/chapter/one.rpym"]["line_count"] == 2
    assert rows["game/script.rpy"]["kind"] == "script" and rows["game/a+b%20c.txt"]["engine"] is None
    assert [r["path"] for r in bad.collect()] == ["game/bad.txt"]
    assert before == {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in project.rglob("*") if p.is_file()}


def test_paths_sort_by_parts(spark):
    df = spark.createDataFrame([("a-b/x",), ("a/x",), ("a/b/c",)], "path string")
    assert [r[0] for r in df.orderBy(projects.by_parts(F.col("path"))).collect()] == ["a/b/c", "a/x", "a-b/x"]


TEMPLATE = '''# game/script.rpy:3
translate french start_1:

    # aoi happy "Hello"
    aoi happy ""

# game/script.rpy:4
translate french start_2:

    # "Wind." nointeract
    ""

translate french start_3:

    # "No reference"
    ""

# game/script.rpy:9
translate french start_4:

    # aoi "One"
    # aoi "Two"
    aoi ""

translate french strings:

    # game\\script.rpy:6
    old "Open"
    new ""

    old "No reference"
    new ""
'''


def test_templates(spark):
    files = spark.createDataFrame([("script.rpy", b"\xef\xbb\xbf" + TEMPLATE.encode())], "path string, content binary")
    found, warned = templates.read_entries(files, "french")
    rows = found.orderBy("ordinal").collect()
    assert [(r["kind"], r["source_text"], r["source_file"], r["line_number"], r["translation_identifier"]) for r in rows] == [
        ("dialogue", "Hello", "game/script.rpy", 3, "start_1"),
        ("narration", "Wind.", "game/script.rpy", 4, "start_2"),
        ("menu_choice", "Open", "game/script.rpy", 6, None),
    ]
    assert warned.count() == 3
    assert templates.read_entries(files, "german")[0].count() == 0


def packed(entries, key=0x42424242, index=None, tail=b"", shift=0):
    head, body, table = 34, b"", {}
    for name, data in entries.items():
        table[name] = [((head + len(body) + shift) ^ key, len(data) ^ key, b"")]
        body += data
    index = zlib.compress(pickle.dumps(table if index is None else index, 4))
    return b"RPA-3.0 %016x %08x\n" % (head + len(body), key) + body + index + tail


def test_archives(spark, tmp_path):
    entries = {"a.rpy": b"label a:\n", "tl/fr/a.rpy": b"x", "a.rpyc": b"c", "p.png": b"p"}
    (tmp_path / "one.rpa").write_bytes(packed(entries))
    (tmp_path / "two.rpa").write_bytes(packed({"b.rpym": b"label b:\n"}))
    rows = {(r["archive"], r["name"]): r for r in archives.read(spark, str(tmp_path)).collect()}
    assert {k[1]: r["kind"] for k, r in rows.items()} == {"a.rpy": "source", "tl/fr/a.rpy": "translation", "a.rpyc": "compiled", "p.png": "other", "b.rpym": "source"}
    assert bytes(rows["one.rpa", "a.rpy"]["content"]) == b"label a:\n" and rows["one.rpa", "p.png"]["content"] is None


class Evil:
    def __reduce__(self):
        return (print, ("run",))


@pytest.mark.parametrize(
    "data",
    [
        b"RPA-2.0 x",
        packed({"a.rpy": b"x"}, tail=b"more"),
        packed({"a.rpy": b"x"}, shift=100),
        packed({"../a.rpy": b"x"}),
        packed({"a\\b.rpy": b"x"}),
        packed({"a.rpy": b"xyz"}, index={"a.rpy": [(34 ^ 0x42424242, 3 ^ 0x42424242)], "b.rpy": [(35 ^ 0x42424242, 1 ^ 0x42424242)]}),
        packed({"a.rpy": b"x"}, index=[1]),
        packed({"a.rpy": b"x"}, index={"a.rpy": Evil()}),
        packed({"a.rpy": b"x"}, index={"a.rpy": [(34 ^ 0x42424242, 1 ^ 0x42424242, b"prefix")]}),
    ],
)
def test_bad_archives_are_refused(tmp_path, data):
    path = tmp_path / "bad.rpa"
    path.write_bytes(data)
    with pytest.raises(archives.ArchiveError):
        list(archives.read_archive(str(path), archives.LIMITS))


def test_limits_only_tighten(tmp_path):
    path = tmp_path / "a.rpa"
    path.write_bytes(packed({"a.rpy": b"x" * 100}))
    with pytest.raises(archives.ArchiveError):
        list(archives.read_archive(str(path), archives.LIMITS | {"file_bytes": 50}))
    assert archives._Reader({"path": str(path), "entries": "7"}).limits["entries"] == 7
    for wider in ({"entries": 10**9}, {"file_bytes": 0}, {"total_bytes": -1}, {"index_bytes": "x"}, {"entries": True}):
        with pytest.raises(archives.ArchiveError):
            archives.limits_of(wider)


@pytest.mark.parametrize(
    ("paths", "wanted"),
    [
        (["game/script.rpy"], "source_ready"),
        (["game/a.rpyc"], "packaged_requires_import"),
        (["game/a.rpa"], "uncertain"),
        (["game/a.rpa", "play.exe"], "packaged_requires_import"),
        (["game/a.rpa", "unins000.exe"], "uncertain"),
        (["game/tl/fr/a.rpy"], "uncertain"),
        (["readme.txt"], "not_renpy"),
        (["renpy/x.py", "play.exe"], "uncertain"),
        (["game/x.png"], "not_renpy"),
    ],
)
def test_compatibility(spark, tmp_path, paths, wanted):
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    assert compatibility.report(compatibility.listing(spark, str(tmp_path))).first()["status"] == wanted


def test_listing_is_bounded(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}").touch()
    with pytest.raises(ValueError):
        compatibility.listing(spark, str(tmp_path), max_entries=3)
    found = compatibility.inspected(spark, str(tmp_path), max_entries=3).first()
    assert found["status"] == "uncertain" and "more than 3 entries" in found["issue"]


def test_the_game_folder_itself_may_be_selected(spark, tmp_path):
    (tmp_path / "Game").mkdir()
    (tmp_path / "Game" / "script.rpy").write_text("label a:\n")
    for folder in (tmp_path, tmp_path / "Game"):
        assert compatibility.inspected(spark, str(folder)).first()["status"] == "source_ready"


def test_endpoints(spark):
    rows = {"https://a.example/v1/chat/completions": True, "http://127.0.0.1:99999/chat/completions": False, "http://127.999.1.1/chat/completions": False, "http://127.0.0.1:8080/chat/completions": True, "https://a.example:x/chat/completions": False}
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    assert {r["u"]: r["ok"] for r in df.select("u", paths.valid_endpoint(F.col("u")).alias("ok")).collect()} == rows


def test_publish(spark, tmp_path):
    files = spark.createDataFrame([("game/tl/fr/a.rpy", "x\ny\n"), ("game/tl/fr/sub/b.rpy", "z")], "relative_path string, content string")
    publish.publish(files, str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.rpy")) == ["game/tl/fr/a.rpy", "game/tl/fr/sub/b.rpy"]
    assert (tmp_path / "out/game/tl/fr/a.rpy").read_bytes() == b"\xef\xbb\xbfx\ny\n"
    with pytest.raises(FileExistsError):
        publish.publish(files, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        publish.publish(files.select(F.lit("game/tl/fr/../x.rpy").alias("relative_path"), "content"), str(tmp_path / "other"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_event_lines(spark, tmp_path):
    good = '{"schema_version":2,"type":"progress","stage":"translating","message":"m","completed_batches":0,"total_batches":3}'
    lines = [
        good,
        good.replace("translating", "thinking"),
        good.replace('"total_batches":3', '"total_batches":0'),
        good.replace(',"completed_batches":0', ""),
        good.replace('"message":"m"', '"message":"m","extra":1'),
        good.replace('"schema_version":2', '"schema_version":1'),
        "[1]",
        good.replace('"m"', f'"{"m" * events.MOST_BYTES}"'),
        '{"schema_version":2,"type":"succeeded"}',
        good,
    ]
    (tmp_path / "run.jsonl").write_text("\n".join(lines) + "\n")
    rows = events.read(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["error"] for r in rows] == [None, "progress", "progress", "progress", "unknown_fields", "version", "no_object", "line_too_long", None, "after_end"]


def test_listings(spark):
    rows = [("game/a.rpy",), ("game/tl/fr/a.rpy",), ("Game/sub/b.RPYM",), ("other/c.rpy",), ("game/p.png",)]
    df = spark.createDataFrame(rows, "path string")
    assert {r["path"] for r in df.where(projects.translatable(F.col("path"))).collect()} == {"game/a.rpy", "Game/sub/b.RPYM"}
    assert projects.exported(df.where("path = 'game/tl/fr/a.rpy'"), "fr").count() == 1
    with pytest.raises(Exception, match="not part of an export"):
        projects.exported(df, "fr").collect()


def test_command_line(spark, project, tmp_path, capsys):
    assert main(["doctor"]) == 0
    assert main(["scan", str(tmp_path / "none")]) == 2
    assert main(["extract", str(project), "-o", str(tmp_path / "out.jsonl")]) == 0
    lines = (tmp_path / "out.jsonl").read_text().splitlines()
    assert len(lines) == 7 and '"source_file":"game/chapter/one.rpym"' in lines[0]
    assert main(["extract", str(project), "-o", str(tmp_path / "out.jsonl")]) == 3
    tl = tmp_path / "tl"
    tl.mkdir()
    (tl / "script.rpy").write_text(TEMPLATE)
    assert main(["check", str(project), str(tl), "french"]) == 4
    assert '"matches":false' in capsys.readouterr().out
