import io
import json
import os
import struct
import zlib

import numpy as np
import pytest

from kindred.functions import images
from kindred.plans import app
from kindred.plans.app import WORKFLOWS
from kindred.plans.options import OptionError, options
from kindred.sinks import files, preview
from kindred.sources.records import scan_files, scan_table


def png(path, pixels):
    """An 8-bit grey PNG."""
    h, w = pixels.shape
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8)))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    """Two equal pictures, a third that differs, and one that can't be decoded."""
    rng = np.random.default_rng(5)
    same = rng.integers(0, 255, (40, 40))
    for name, pixels in (("a.png", same), ("sub/b.png", same), ("c.png", rng.integers(0, 255, (40, 40)))):
        png(tmp_path / "in" / name, pixels)
    (tmp_path / "in" / "broken.png").write_bytes(b"no picture")
    return tmp_path / "in"


def config(tmp_path, text):
    (tmp_path / "c.yaml").write_text(text)
    return ["--config", str(tmp_path / "c.yaml")]


def test_file_over_line_over_default(folder, tmp_path):
    o = options([str(tmp_path), "--batch-size", "128", "--k", "7", "--no-report", *config(tmp_path, f"command: dedup\nfolders: [{folder}]\nbatch_size: 32\nno_report: false\nyes: true\n")])
    assert (o.folders, o.batch_size, o.k, o.no_report, o.yes, o.cosine_auto) == ([str(folder)], 32, 7, False, True, 0.97)
    assert o.report == str(folder / "dedup_report.json")


@pytest.mark.parametrize("text", ["odd: 1", "k: null", "inplace: yes", 'inplace: "true"', "k: [1]", "folders: x", "keep_policy: best", "- 1", "command: other", "k: many", "cosine_auto: 0.1", "hard_delete: true", "gpu_memory_fraction: 2"])
def test_bad_files(folder, tmp_path, text):
    with pytest.raises(OptionError):
        options([str(folder), *config(tmp_path, text)])


def test_commands_agree(folder, tmp_path):
    file = config(tmp_path, f"command: select\nfolder: {folder}\noutput: {tmp_path / 'out'}\nnum: 10\n")
    assert options(["select", *file]).num == 10 == options(file).num
    with pytest.raises(OptionError):
        options(["remove-like", *file])
    with pytest.raises(OptionError):
        options(["select", str(folder)])


def test_discard_and_restore(folder):
    a, b = str(folder / "a.png"), str(folder / "sub" / "b.png")
    out = files.discard([a, b, str(folder / "none.png")], [str(folder)], run_id="r")
    assert (out["successfully_moved"], out["already_deleted"], out["total_attempted"], out["actual_errors"]) == (2, 1, 3, 0)
    assert (folder / files.TRASH / "r" / "sub" / "b.png").is_file() and not os.path.exists(a)
    assert [r[2] for r in scan_files([str(folder)])] == [str(folder / "broken.png"), str(folder / "c.png")]
    (folder / "a.png").write_bytes(b"new")
    assert files.trash_place(a, [str(folder)], "r").endswith("a.1.png")
    assert files.restore(out["manifest_path"]) == 1 and os.path.exists(b)


def test_discard_hard_and_errors(folder):
    out = files.discard([str(folder / "a.png"), str(folder / "sub")], [str(folder)], hard=True)
    assert (out["successfully_deleted"], out["actual_errors"], out["manifest_path"]) == (1, 1, None)


def test_output_is_guarded(folder, tmp_path):
    out = tmp_path / "out"
    for bad in (folder / "x", tmp_path, folder):
        with pytest.raises(ValueError):
            files.check_output(str(folder), str(bad), True)
    out.mkdir()
    (out / "mark").write_text("1")
    with pytest.raises(FileExistsError):
        files.check_output(str(folder), str(out))
    (tmp_path / "link").symlink_to(out)
    with pytest.raises(ValueError):
        files.check_output(str(folder), str(tmp_path / "link"), True)
    with pytest.raises(RuntimeError), files.staged(str(folder), str(out), True):
        raise RuntimeError
    assert (out / "mark").exists()
    with files.staged(str(folder), str(out), True) as new:
        assert [e["status"] for e in files.export([str(folder / "sub" / "b.png"), str(folder / "none.png")], str(folder), new)] == ["exported", "export_failed"]
    assert (out / "images" / "sub" / "b.png").is_file() and not (out / "mark").exists()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "link", "out"]


def test_dedup_folder(spark, folder):
    said = WORKFLOWS["dedup"](spark, options(["dedup", str(folder), "--keep-policy", "lexi", "--inplace"]))
    written = json.loads((folder / "dedup_report.json").read_text())
    assert (written["total_images"], written["duplicate_groups"], written["total_duplicates"]) == (4, 1, 1)
    assert written["groups"][0]["keep"] == str(folder / "a.png")
    assert written["groups"][0]["duplicates"][0] | {"cosine": 1} == {"path": str(folder / "sub" / "b.png"), "reason": "same_sha256", "cosine": 1, "phash_distance": 0, "same_sha256": True, "confidence": "exact"}
    assert said["removed"]["successfully_moved"] == 1 and not (folder / "sub" / "b.png").exists() and (folder / "c.png").exists()


def test_remove_like_folder(spark, folder, tmp_path):
    outside = tmp_path / "ref.png"
    outside.write_bytes((folder / "a.png").read_bytes())
    WORKFLOWS["remove-like"](spark, options(["remove-like", str(folder), str(outside)]))
    written = json.loads((folder / "remove_like_report.json").read_text())
    assert [d["path"] for d in written["groups"][0]["duplicates"]] == [str(folder / "a.png"), str(folder / "sub" / "b.png")]
    assert (written["reference_image"], written["total_images"]) == (str(outside), 4) and (folder / "a.png").exists()


def test_select_folder(spark, folder, tmp_path):
    out = tmp_path / "out"
    said = WORKFLOWS["select"](spark, options(["select", str(folder), "--output", str(out), "--num", "2", "--selection-method", "farthest", "--keep-policy", "lexi"]))
    assert said["funnel"] == {"input": 4, "quality_rejected": 0, "eligible_after_quality": 4, "duplicate_groups": 1, "duplicates_removed": 1, "embedding_failed": 1, "eligible_after_dedup": 2, "selected": 2, "export_failed": 0}
    assert sorted(os.listdir(out / "images")) == ["a.png", "c.png"]
    assert (out / "reports" / "rejected_all.txt").read_text().splitlines() == [f"duplicate\t{folder / 'sub' / 'b.png'}", f"embedding_failed\t{folder / 'broken.png'}"]
    assert len((out / "reports" / "selected_images.csv").read_text().splitlines()) == 3


def exif(order, turn):
    """A JPEG's first bytes: a comment, then an Exif segment with one other tag and the orientation."""
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x0100, 4, 1, 9) + struct.pack(order + "HHIHH", 0x0112, 3, 1, turn, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xfe\0\x05abc\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


@pytest.mark.parametrize("turn", range(1, 9))
def test_orientation(turn):
    assert images.orientation(io.BytesIO(exif("<", turn))) == images.orientation(io.BytesIO(exif(">", turn))) == turn
    a = np.arange(6).reshape(2, 3)
    # the corner that is seen at the upper left, and its neighbour to the right
    corner = {1: (0, 1), 2: (2, 1), 3: (5, 4), 4: (3, 4), 5: (0, 3), 6: (3, 0), 7: (5, 2), 8: (2, 5)}[turn]
    up = images.upright(a, turn)
    assert tuple(up[0, :2]) == corner and up.shape == ((3, 2) if turn >= 5 else (2, 3))
    m00, m10, m01, m11, m02, m12 = preview._turned(turn, 3, 2)
    for y in range(2):
        for x in range(3):  # pixel centres
            u, v = m00 * (x + 0.5) + m01 * (y + 0.5) + m02, m10 * (x + 0.5) + m11 * (y + 0.5) + m12
            assert up[int(v), int(u)] == a[y, x]


def test_damaged_orientation():
    whole = exif("<", 6)
    for n in range(len(whole) - 8):
        assert images.orientation(io.BytesIO(whole[:n])) == 1
    for other in (b"", b"\x89PNG", exif("<", 0), exif("<", 9), whole.replace(b"II*", b"XX*")):
        assert images.orientation(io.BytesIO(other)) == 1


def test_turned_and_clear_pictures(spark, tmp_path):
    """A JPEG with an orientation is measured as if it had been saved upright; clear pixels are white in the vector."""
    java, rgb = spark._jvm.java, 1
    picture = java.awt.image.BufferedImage(48, 32, rgb)
    brush = picture.createGraphics()
    brush.setColor(java.awt.Color.WHITE)
    brush.fillRect(0, 0, 20, 10)
    spark._jvm.javax.imageio.ImageIO.write(picture, "jpg", java.io.File(str(tmp_path / "a.jpg")))
    plain = (tmp_path / "a.jpg").read_bytes()
    (tmp_path / "b.jpg").write_bytes(exif("<", 6)[:-4] + plain[2:])
    rows = {r.path[-5:]: r for r in images.measure_pictures(spark, str(tmp_path), vectors=True).collect()}
    assert (rows["a.jpg"].width, rows["a.jpg"].height) == (48, 32) and (rows["b.jpg"].width, rows["b.jpg"].height) == (32, 48)
    assert rows["a.jpg"].phash != rows["b.jpg"].phash and rows["a.jpg"].brightness == pytest.approx(rows["b.jpg"].brightness)
    pixels = bytes([0, 0, 0, 0, 0, 0, 0, 255])
    assert images.gray_of(pixels, 1, 2, 4, on_white=True).tolist() == [[255, 0]] and images.gray_of(pixels, 1, 2, 4).tolist() == [[0, 0]]


def test_contact_sheet(spark, folder, tmp_path):
    out = tmp_path / "sheets" / "s.jpg"
    assert preview.contact_sheet(spark, [], str(out)) == 0 and not out.exists()
    for bad in ({"columns": 0}, {"size": 31}):
        with pytest.raises(ValueError):
            preview.contact_sheet(spark, ["a"], str(out), **bad)
    paths = [str(folder / n) for n in ("a.png", "broken.png", "none.png", "c.png")]
    assert preview.contact_sheet(spark, paths, str(out), columns=3, size=64) == 2
    sheet = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(out)))
    assert (sheet.getWidth(), sheet.getHeight()) == (3 * 64, 2 * 88)
    gray = lambda x, y: sheet.getRGB(x, y) & 255
    assert min(gray(x, 30) for x in range(14, 50)) < 100  # the first picture, in the middle of its cell
    assert all(gray(x, y) > 240 for x in range(70, 186) for y in (5, 30, 60, 80))  # two blank cells
    assert min(gray(x, y) for x in range(3, 60) for y in range(66, 86)) < 128  # a label
    assert preview.label(9, "/x/" + "n" * 40) == "10. " + "n" * 24


def test_cached_run(spark, folder, monkeypatch):
    """The second run reads no file, a changed file alone is read again, and the results are the same."""
    read, plain = [], app.pictures
    monkeypatch.setattr(app, "pictures", lambda spark, scanned, places: read.append(sorted(os.path.basename(p) for p in places)) or plain(spark, scanned, places))
    line = ["dedup", str(folder), "--keep-policy", "lexi", "--save-faiss-index"]

    def run():
        WORKFLOWS["dedup"](spark, options(line))
        return {k: v for k, v in json.loads((folder / "dedup_report.json").read_text()).items() if k != "generated_at"}

    first = run()
    assert run() == first and first["total_duplicates"] == 1
    assert spark.read.parquet(str(folder / ".kindred" / "vectors")).count() == 3
    png(folder / "sub" / "b.png", np.random.default_rng(8).integers(0, 255, (40, 41)))
    assert run()["total_duplicates"] == 0
    # a file that can't be decoded is tried each time
    assert read == [["a.png", "b.png", "broken.png", "c.png"], ["broken.png"], ["b.png", "broken.png"]]
    (folder / "broken.png").unlink()
    assert run()["total_images"] == 3 and len(read) == 3


def test_selection_with_sheet(spark, folder, tmp_path):
    out = tmp_path / "out"
    WORKFLOWS["select"](spark, options(["select", str(folder), "--output", str(out), "--num", "2", "--selection-method", "kmeans", "--make-preview", "--preview-size", "40"]))
    assert (out / "previews" / "selected.jpg").stat().st_size > 0 and len(os.listdir(out / "images")) == 2


def test_odd_names(spark, tmp_path):
    """Names that hold spaces, patterns or escapes are read as they are, by folder and one by one."""
    names = ["c [1].png", "d{a,b}.png", "e*?.png", "f%20g.png", "h#\u00e9.png"]
    for n in names:
        png(tmp_path / "in [x]" / n, np.arange(400).reshape(20, 20) % 251)
    rows = scan_table(spark, [str(tmp_path / "in [x]")])
    for places in ([str(tmp_path / "in [x]")], [str(tmp_path / "in [x]" / n) for n in names]):
        found = app.pictures(spark, rows, places).collect()
        assert sorted(os.path.basename(r.path) for r in found) == sorted(names) and all(r.sha256 and r.phash and r.embedding for r in found)
