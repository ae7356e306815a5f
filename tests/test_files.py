"""Containers, tables in files, limits, the ledger and the parse run."""

import os
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.operators import parse
from quillstone.sources import containers, files, tables
from quillstone.sources.grids import grid

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def compound(tree):
    """A compound file of {name: bytes or {name: bytes}}: small streams in the root's own stream, entries linked to the right."""
    entries, small, big = [["Root Entry", 5, FREE, FREE, END, 0]], b"", []

    def add(folder):
        first = before = None
        for name, value in folder.items():
            entries.append([name, 1 if isinstance(value, dict) else 2, FREE, FREE, END, 0])
            i = len(entries) - 1
            if before is None:
                first = i
            else:
                entries[before][2] = i
            before = i
            if isinstance(value, dict):
                entries[i][3] = add(value)
            else:
                entries[i][5] = len(value)
                if len(value) < 4096:
                    nonlocal small
                    entries[i][4] = len(small) // 64
                    small += value.ljust(-(-len(value) // 64) * 64, b"\0")
                else:
                    big.append((i, value))
        return FREE if first is None else first

    links = []
    entries[0][3] = add(tree)
    for e in entries:
        if e[1] == 2 and e[5] < 4096:
            n = -(-e[5] // 64)
            links += [*range(e[4] + 1, e[4] + n), END][:n]
    body, fat = b"", [0xFFFFFFFD]

    def put(data):
        nonlocal body
        start, n = len(fat), -(-len(data) // 512)
        fat.extend([*range(start + 1, start + n), END][:n])
        body += data.ljust(n * 512, b"\0")
        return start if n else END

    for i, value in big:
        entries[i][4] = put(value)
    entries[0][4], entries[0][5] = put(small), len(small)
    small_at = put(struct.pack(f"<{len(links)}I", *links).ljust(-(-len(links) // 128) * 512, b"\xff"))
    raw = b""
    for name, kind, right, child, start, n in entries:
        raw += name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", len(name) * 2 + 2, kind, 1, FREE, right, child) + bytes(36) + struct.pack("<IQ", start, n)
    dir_at = put(raw)
    head = containers.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, dir_at, 0, 4096, small_at, 1, END, 0) + struct.pack("<I", 0)
    assert len(head) == 80 and len(fat) <= 128
    return head.ljust(512, b"\xff") + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + body


def record(tag, body, level=0):
    long = len(body) >= 0xFFF
    return struct.pack("<I", tag | level << 10 | min(len(body), 0xFFF) << 20) + (struct.pack("<I", len(body)) if long else b"") + body


def cell(row, column, tall, wide, text, level):
    return record(72, bytes(8) + struct.pack("<4H", column, row, wide, tall) + bytes(8), level) + record(67, text.encode("utf-16-le"), level + 1)


def hwp(*sections, packed=True, summary=True):
    squeeze = zlib.compressobj
    pack = lambda s: (lambda c: c.compress(s) + c.flush())(squeeze(wbits=-15)) if packed and s != b"broken" else s
    tree = {"FileHeader": bytes(36) + bytes([packed]) + bytes(219), "BodyText": {f"Section{i}": pack(s) for i, s in reversed(list(enumerate(sections)))}}
    return compound({**tree, **({"\x05HwpSummaryInformation": b"s"} if summary else {})})


def test_compound_file():
    big = bytes(range(256)) * 40
    found = containers.streams(compound({"a": b"small", "s": {"b": big, "c": b"x" * 4095, "e": b""}, "d": b"y" * 65}))
    assert {k: v() for k, v in found.items()} == {"a": b"small", "s/b": big, "s/c": b"x" * 4095, "s/e": b"", "d": b"y" * 65}
    for bad in (b"", b"no", containers.SIGNATURE + bytes(504), compound({"a": b"1"})[:700]):
        with pytest.raises((ValueError, struct.error, IndexError)):
            containers.streams(bad)


def test_chains_that_turn_back_are_errors():
    with pytest.raises(ValueError, match="broken chain"):
        containers._chain(0, [1, 0])


def test_hwp_sections_and_tables():
    text = lambda t: record(67, t.encode("utf-16-le"), 1)
    inner = record(71, b"", 3) + record(77, bytes(8), 4) + cell(0, 0, 1, 1, "in", 4)
    table = record(71, b"", 1) + record(77, bytes(8), 2) + cell(0, 0, 1, 2, "head", 2) + cell(1, 0, 1, 1, "a", 2) + inner + cell(1, 1, 1, 1, "b", 2)
    sections = [text("zero") + table + text("after")] + [text(f"s{i}") for i in range(1, 11)] + [b"broken"]
    for packed in (True, False):
        ((got, grids),) = files.read_hwp(hwp(*sections[: 12 if packed else 11], packed=packed))
        assert got.split("\n")[0] == "zero" and got.endswith("s8\ns9\ns10") and "after" in got
        assert grids == [[["head", "head"], ["a\nin", "b"]], [["in"]]]
    assert files.parse_hwp(hwp(text("x" * 5000)))[0] == "x" * 5000
    with pytest.raises(ValueError, match="not a HWP file"):
        files.read_hwp(hwp(b"", summary=False))


def test_controls_of_paragraphs():
    units = struct.pack("<3H", 65, 13, 66) + struct.pack("<8H", 11, 1, 2, 3, 4, 5, 6, 11) + struct.pack("<H", 67) + struct.pack("<8H", 9, *[7] * 7) + "한".encode("utf-16-le")
    assert files._plain(units) == "ABC\t한" and files._plain(b"") == "" and files._plain(b"A\0x") == "A"


def test_grid():
    assert grid([]) == []
    assert grid([(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b"), (1, 1, 1, 1, "c"), (1, 2, 1, 1, "d")]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert grid([(0, 0, 1, 1, "a"), (1, 1, 1, 1, "d")]) == [["a", None], [None, "d"]]
    assert grid([(0, 0, 10**9, 10**9, "a"), (9, 60000, 1, 1, "b")]) == [["a", "a"], ["a", "a"]]
    with pytest.raises(ValueError, match="places"):
        grid([(i, i, 1, 1, "") for i in range(1001)])


def hwpx(path, *bodies):
    with zipfile.ZipFile(path, "w") as z:
        for i, b in enumerate(bodies):
            z.writestr(f"Contents/section{i}.xml", f'<s:sec xmlns:s="urn:s" xmlns:p="urn:p">{b}</s:sec>')


def tc(text, address=None, span=None, more=""):
    at = f'<p:cellAddr rowAddr="{address[0]}" colAddr="{address[1]}"/>' if address else ""
    return f'<p:tc><p:subList><p:p><p:run><p:t>{text}</p:t>{more}</p:run></p:p></p:subList>{at}<p:cellSpan rowSpan="{(span or (1, 1))[0]}" colSpan="{(span or (1, 1))[1]}"/></p:tc>'


def tbl(*rows):
    return "<p:tbl>" + "".join(f"<p:tr>{''.join(r)}</p:tr>" for r in rows) + "</p:tbl>"


def para(text, table=""):
    return f"<p:p><p:run><p:t>{text}</p:t></p:run><p:run>{table}</p:run></p:p>"


def test_hwpx_tables_to_markdown(spark, tmp_path):
    nested = tbl([tc("n1"), tc("n2")])
    table = tbl([tc("item", (0, 0), (2, 1)), tc("price", (0, 1), (1, 2))], [tc("net", (1, 1)), tc("gross", (1, 2))], [tc("x", (2, 0), None, nested), tc("1", (2, 1)), tc("2", (2, 2))])
    hwpx(tmp_path / "t.HWPX", para("before", table))
    hwpx(tmp_path / "u.hwpx", para("none"))
    rows = {r["file_name"]: r for r in files.load(spark, str(tmp_path)).select("*", files.with_tables(F.col("text"), F.col("tables")).alias("both")).collect()}
    want = [[["item", "price", "price"], ["item", "net", "gross"], ["x\nn1\nn2", "1", "2"]], [["n1", "n2"]]]
    assert [[list(r) for r in g] for g in rows["t.HWPX"]["tables"]] == want and list(rows["u.hwpx"]["tables"]) == []
    lines = rows["t.HWPX"]["both"].split("[Table]\n")[1].split("\n\n")
    back = [[[c.strip() for c in line.strip("|").split("|")] for line in t.split("\n") if "---" not in line] for t in lines]
    assert back == [[[c.replace("\n", " ") for c in r] for r in g] for g in want]
    assert rows["u.hwpx"]["both"] == "none"


def slow(data):
    if data == b"sleep":
        time.sleep(60)
    if data == b"die":
        os._exit(9)
    if data == b"bad":
        raise ValueError("broken")
    return data.decode().split("|")


def test_a_file_that_takes_too_long_is_a_row(spark, tmp_path):
    for name, data in (("a.pdf", b"one|two"), ("b.pdf", b"sleep"), ("c.pdf", b"die"), ("d.pdf", b"bad"), ("e.pdf", b"last"), ("f.pdf", b"x" * 3_000_000)):
        (tmp_path / name).write_bytes(data)
    start = time.time()
    rows = files.load(spark, str(tmp_path), {".pdf": slow}, seconds=1.5).coalesce(1).select("file_name", "page", F.length("text").alias("n"), "error").orderBy("file_name", "page").collect()
    assert time.time() - start < 40
    assert [tuple(r) for r in rows] == [
        ("a.pdf", 0, 3, None), ("a.pdf", 1, 3, None), ("b.pdf", 0, None, "TimeoutError: more than 1.5 s"), ("c.pdf", 0, None, "ChildProcessError: the parser's process ended"),
        ("d.pdf", 0, None, "ValueError: broken"), ("e.pdf", 0, 4, None), ("f.pdf", 0, 3_000_000, None),
    ]


def test_ledger(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    (folder / "sub").mkdir(parents=True)
    for name, data in (("a.pdf", b"one|two"), ("sub/b {1}[x] ß.PDF", b"three"), ("c.pdf", b"bad"), ("z.txt", b"no")):
        (folder / name).write_bytes(data)
    run = lambda **more: sorted((r["source"].rpartition("/")[2], r["pages"], r["characters"], r["error"]) for r in files.sync(spark, str(folder), out, {".pdf": slow}, slice_files=2, **more).collect())
    now = lambda: sorted((r["file_name"], r["page"], r["text"]) for r in files.current(spark, out).collect())
    first = [("a.pdf", 2, 6, None), ("b {1}[x] ß.PDF", 1, 5, None), ("c.pdf", 0, 0, "ValueError: broken")]
    assert run() == first and run() == []
    assert files.ledger(spark, out).select("slice").distinct().count() == 2
    assert now() == [("a.pdf", 0, "one"), ("a.pdf", 1, "two"), ("b {1}[x] ß.PDF", 0, "three"), ("c.pdf", 0, None)]
    (folder / "a.pdf").write_bytes(b"changed")
    os.utime(folder / "a.pdf", (time.time() + 10, time.time() + 10))
    assert run() == [("a.pdf", 1, 7, None)] and run(retry=True) == first[2:]
    assert now() == [("a.pdf", 0, "changed"), ("b {1}[x] ß.PDF", 0, "three"), ("c.pdf", 0, None)]
    (tmp_path / "out" / "pages" / "slice=cut-off").mkdir()
    files.current(spark, out).limit(1).write.parquet(str(tmp_path / "out" / "pages" / "slice=cut-off" / "part"))
    assert files.current(spark, out).count() == 3


def test_parse_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    hwpx(folder / "plan (1).hwpx", para("A plan. " * 90, tbl([tc("k"), tc("v")])))
    (folder / "other.pdf").write_bytes(b"page one|page two||")
    (folder / "bad.pdf").write_bytes(b"bad")
    (tmp_path / "m.csv").write_text("파일명,공고 번호,사업명,사업 금액\nplan.hwpx,N1,Plan,\"1,000원\"\nplan.hwpx,N2,Second,5\nnothing.pdf,N3,No,1\n")
    meta = tables.read_metadata(spark, str(tmp_path / "m.csv"))
    files.sync(spark, str(folder), str(tmp_path / "out"), {**files.PARSERS, ".pdf": slow})
    pages = files.current(spark, str(tmp_path / "out"))
    for mode, more in (("recursive", {"size": 300, "overlap": 30}), ("sentence", {}), ("fixed", {}), ("semantic", {})):
        rows = parse.chunks(pages, meta, mode, **more).orderBy("chunk_id").collect()
        assert {(r["doc_id"], r["title"]) for r in rows} == {("N1", "Plan"), ("other", "other")}
        assert [(r["chunk_id"], r["page_number"], r["content"]) for r in rows if r["doc_id"] == "other"] == [("other_0001", 1, "page one"), ("other_0002", 2, "page two")]
        plan = [r for r in rows if r["doc_id"] == "N1"]
        assert [r["chunk_id"] for r in plan] == [f"N1_{i + 1:04d}" for i in range(len(plan))] and len(plan) > (mode in ("recursive", "fixed")) and any("| k | v |" in r["content"] for r in plan)
    assert parse.chunks(pages.limit(0), meta).count() == 0
