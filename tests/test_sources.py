import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from wireloom.config import Config
from wireloom.operators import raster, specialists
from wireloom.plans import pictures
from wireloom.sinks import netlists
from wireloom.sources import domains, drawings, kicad, library
from wireloom.streaming import folder

SEXP = """(kicad_symbol_lib (version 1) (symbol "R\\"1" (pin_names (offset 0))
  (symbol "R_0_1" (polyline (pts (xy -1 0) (xy 1 0)) (stroke (width 0))) (rectangle (start -1 -2) (end 1 2)) (circle (center 0 0) (radius 3)) (arc (start 1 0) (mid 0 1) (end -1 0)) (text "ignored"))
  (symbol "R_1_1" (pin passive line (at 0 5 270) (length 2) (name "~") (number "1")) (pin passive line (at 0 -5)))) (symbol "Empty"))"""


def png(path, picture):
    """A gray PNG."""
    h, w = picture.shape
    raw = b"".join(b"\0" + row.tobytes() for row in picture.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_kicad(spark, tmp_path):
    (tmp_path / "a.kicad_sym").write_text(SEXP)
    df = kicad.symbols(spark, str(tmp_path))
    rows = df.orderBy("ord").collect()
    assert [(r.symbol, r.kind) for r in rows] == [('R"1', k) for k in ("polyline", "rectangle", "circle", "arc", "pin", "pin")]
    assert (rows[4].angle, rows[4].length, rows[4].number) == (270.0, 2.0, "1") and (rows[5].angle, rows[5].length, rows[5].number) == (0.0, 0.0, "")
    assert tuple(kicad.bounds(df, ["symbol"]).first())[1:] == (-3.0, -5.0, 3.0, 5.0)
    got = sorted((r.ord, r.x, r.y, r.body_x, r.body_y) for r in kicad.terminals(df, ["symbol"]).collect())
    assert got == [(4, 72, 12, 72, 52), (5, 72, 212, 72, 212)]
    assert kicad.parse("(a (b") == [["a", ["b"]]] and kicad.parse(") x") == ["x"]
    assert kicad.arc_angles((1, 0), (0, 1), (-1, 0), (0, 0)) == (0.0, 180.0)
    assert kicad.arc_angles((1, 0), (0, -1), (-1, 0), (0, 0)) == (180.0, 360.0)


def test_golden_drawings(spark, tmp_path):
    one = {"symbols": [{"id": "R1", "type": "Resistor", "coordinates": [1, 2, 3, 4], "connections": ["C1"]}, {"id": "C1", "type": "Capacitor", "coordinates": [5, 6, 7, 8]}], "_connectivity_verified": True}
    (tmp_path / "D1.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "D2.json").write_text('{"symbols": [], "_notes": "n", "_excluded_false_positives": [{"id": "x"}]}')
    read = drawings.drawings(spark, str(tmp_path))
    assert sorted((r.drawing_id, r.verified, len(r.symbols)) for r in read.collect()) == [("D1", True, 2), ("D2", False, 0)]
    rows = drawings.symbols(read).orderBy("idx").collect()
    assert [(r.id, r.x0, r.y1, r.connections) for r in rows] == [("R1", 1, 4, ["C1"]), ("C1", 5, 8, [])]
    back = json.loads(netlists.netlists(drawings.symbols(read)).first().json)
    assert back == {"symbols": [{"id": "R1", "type": "Resistor", "coordinates": [1, 2, 3, 4], "connections": ["C1"]}, {"id": "C1", "type": "Capacitor", "coordinates": [5, 6, 7, 8], "connections": []}]}


def test_stream_of_drawings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: folder.run(folder.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    for k in range(3):
        (tmp_path / "in" / f"D{k}.json").write_text(json.dumps({"symbols": [{"id": f"R{k}", "type": "R", "coordinates": [0, 0, k, k]}]}, indent=1))
        run()
    got = spark.read.json(str(tmp_path / "out"))
    assert {(r.drawing_id, json.loads(r.json)["symbols"][0]["id"]) for r in got.collect()} == {("D0", "R0"), ("D1", "R1"), ("D2", "R2")}
    assert got.count() == 3


def test_library(spark, tmp_path):
    png(tmp_path / "lib/Resistor/r.png", np.full((20, 40), 255))
    png(tmp_path / "lib/Diode/d.png", np.full((30, 30), 0))
    (tmp_path / "lib/Resistor/r.terminals.json").write_text('[{"name": "1", "point": [0, 10], "body": [5, 10]}, {"name": "2", "point": [39, 10]}]')
    found = library.files(spark, str(tmp_path / "lib"))
    assert sorted((r["class"], r.file) for r in found.collect()) == [("Diode", "Diode/d.png"), ("Resistor", "Resistor/r.png")]
    now = library.signature(found, "m")
    assert now == library.signature(found.repartition(5), "m") != library.signature(found, "other")
    built = []
    build = lambda: built.append(1) or spark.createDataFrame([(1, [0.5])], "entry int, v array<double>")
    for s in (now, now, "changed"):
        assert library.cached(spark, str(tmp_path / "cache"), s, build).count() == 1
    assert len(built) == 2
    ends = drawings.sidecars(spark, str(tmp_path / "lib/*/*.terminals.json"))
    assert sorted((r["class"], r.name, r.idx, r.x, r.body_x) for r in ends.collect()) == [("Resistor", "r", 0, 0, 5), ("Resistor", "r", 1, 39, 39)]
    size = spark.createDataFrame([("Resistor", "r", 40, 20)], "class string, name string, width int, height int")
    got = {(r.turn, r.mirrored): (r.tx, r.ty) for r in library.templates(ends, size).where("idx = 0").collect()}
    assert len(got) == 8 and got[0, False] == (0.0, 0.5) and got[90, False] == (9 / 20, 0.0) and got[0, True] == (39 / 40, 0.5) and got[180, True] == (0.0, 9 / 20)


def test_graph_texts(spark):
    nodes = spark.createDataFrame([(1, "R1", "symbol", "a<b"), (1, "N0", "net", None)], "drawing_id int, node string, kind string, label string")
    edges = spark.createDataFrame([(1, "R1", "N0")], "drawing_id int, a string, b string")
    import xml.etree.ElementTree as ET

    root = ET.fromstring(netlists.graphml(nodes, edges).first().xml)
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert [(n.get("id"), n[1].text) for n in root.iter(f"{space}node")] == [("N0", None), ("R1", "a<b")]
    back = json.loads(netlists.node_link(nodes, edges).first().json)
    assert back["links"] == [{"source": "R1", "target": "N0"}] and [n["id"] for n in back["nodes"]] == ["N0", "R1"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("snap_reach: 30\ndomain: pid\n")
    assert Config.load(str(tmp_path / "c.yaml")) == Config(snap_reach=30, domain="pid") and Config.load() == Config()
    with pytest.raises(TypeError):
        Config(snap_reach="far")
    with pytest.raises(TypeError):
        Config(nothing=1)
    assert domains.listed() == ["electronic", "pid"]


def strokes(h, w, *lines):
    out = np.zeros((h, w), bool)
    for y0, y1, x0, x1 in lines:
        out[y0:y1, x0:x1] = True
    return out


def test_thinning_and_degrees():
    mask = strokes(40, 40, (18, 21, 2, 38), (2, 38, 18, 21))
    thin = raster.skeleton(mask)
    assert 0 < thin.sum() < mask.sum() / 2 and not (thin & ~mask).any()
    assert raster.labels(thin).max() == 1 and (raster.degree(thin) >= 3).any() and (raster.degree(thin) == 1).sum() == 4
    lines = strokes(40, 40, (19, 20, 2, 38), (2, 38, 19, 20))
    assert raster.dots(lines) == []
    yy, xx = np.ogrid[:40, :40]
    assert raster.dots(lines | ((yy - 19) ** 2 + (xx - 19) ** 2 <= 36))


def test_masks():
    mask = strokes(30, 60, (5, 6, 0, 60), (10, 25, 20, 40))
    assert raster.thick(mask).sum() == 300 and raster.thin(mask).sum() == 60
    mask[28, 50] = True
    assert raster.without_speckles(mask, 2).sum() == 360
    assert raster.stats(raster.labels(mask))[0] == (0, 5, 60, 6, 60)
    values = np.random.default_rng(1).integers(0, 5, (12, 15))
    assert raster.sums(values, 3)[5, 7] == values[4:7, 6:9].sum()
    gray = np.where(mask, 20, 230).astype(np.uint8)
    assert 20 <= raster.otsu(gray) < 230
    assert (raster.ink(gray, 31, 7) & mask).sum() > 100 and not raster.ink(np.full((20, 20), 255, np.uint8)).any()
    assert raster.gray(bytes([10, 20, 30, 10, 20, 30]), 1, 2, 3).tolist() == [[22, 22]]


def test_wires_pass_through_boxes():
    mask = strokes(60, 100, (30, 31, 0, 100), (20, 42, 45, 50))
    left = raster.wires(mask, [(40, 15, 60, 45)])
    assert left[30].all() and not left[20:29, 45:50].any()
    ends = strokes(60, 100, (30, 31, 0, 50), (20, 42, 45, 50))
    assert not raster.wires(ends, [(40, 15, 60, 45)])[30, 40:60].any()
    assert raster.attachments(strokes(60, 100, (29, 31, 0, 100)), 40, 15, 60, 45) == [(40, 29, 180.0), (60, 29, 0.0)]
    term = [{"idx": 0, "x": 58, "y": 30, "name": "1", "source": "library", "direction_deg": None}]
    got = raster.refined(term, [(40, 29, 180.0), (60, 29, 0.0)])
    assert [(t["idx"], t["x"], t["direction_deg"]) for t in got] == [(0, 60, 0.0), (1, 40, 180.0)]
    assert raster.square(np.zeros((2, 4))).shape == (4, 4) and len(raster.variants(np.zeros((2, 4)))) == 8
    assert raster.variants(np.array([[1, 2]]), [90], False)[0][2].tolist() == [[1], [2]]


def test_specialist_facts(spark):
    picture = np.full((60, 40), 255, np.uint8)
    for y in (10, 20, 30, 40):
        picture[y : y + 2, 8:32] = 0
    assert specialists.facts(picture) == {"plates": 4, "curved": False, "plus": False}
    assert specialists.facts(np.ascontiguousarray(picture.T))["plates"] == 4
    picture[30:42] = 255
    picture[50:57, 4:11] = np.where(strokes(7, 7, (3, 4, 0, 7), (0, 7, 3, 4)), 0, 255)
    assert specialists.facts(picture) == {"plates": 2, "curved": False, "plus": True}
    assert specialists.facts(np.zeros((5, 40), np.uint8)) is None
    df = spark.createDataFrame([(1, 60, 40, bytearray(picture.tobytes())), (2, 1, 1, None)], "k int, height int, width int, data binary")
    assert sorted((r.k, r.plates) for r in specialists.shape_facts(df).collect()) == [(1, 2), (2, None)]


def test_picture_to_nets(spark, tmp_path):
    picture = np.full((120, 160), 255, np.uint8)
    picture[60:62, 5:60] = 0
    picture[60:62, 100:155] = 0
    for x in range(62, 100, 6):  # a coil
        picture[50:72, x : x + 2] = 0
    picture[50:52, 62:100] = 0
    picture[70:72, 62:100] = 0
    png(tmp_path / "D1.png", picture)
    images = drawings.images(spark, str(tmp_path))
    assert images.first().drawing_id == "D1"
    boxes = pictures.boxes(images).collect()
    assert any(b.x0 <= 70 and b.x1 >= 90 and b.y0 <= 56 and b.y1 >= 66 for b in boxes)
    symbols = spark.createDataFrame([("D1", 60, 48, 100, 74)], "drawing_id string, x0 int, y0 int, x1 int, y1 int")
    assert pictures.nets(images, symbols).select("net_ord").distinct().count() == 2
    given = pictures.boxes(images, detect=lambda g: [{"x0": 0, "y0": 0, "x1": g.shape[1], "y1": 5, "kind": "symbol", "class": "R", "confidence": 0.5, "source": "own"}])
    assert [(b.x1, b["class"]) for b in given.collect()] == [(160, "R")]


def test_readings(spark):
    from wireloom.sources import readings

    rows = [(1, 0, " R1 ", "95.5", 30, 60, 30, 12, 0), (1, 1, "C2", "n/a", 0, 0, 3, 3, 0), (1, 2, "  ", "90", 0, 0, 3, 3, 0), (1, 3, "L3", "-1", 0, 0, 3, 3, 0), (1, 4, "Q4", "0", 12, 30, 9, 6, 90), (1, 5, "D5", None, 0, 0, 3, 3, 0)]
    raw = spark.createDataFrame([(*r, 300, 150) for r in rows], "drawing_id int, ord int, text string, conf string, left int, top int, width int, height int, orientation int, page_width int, page_height int")
    got = {r.ord: tuple(r)[2:] for r in readings.tokens(raw).collect()}
    assert got == {0: ("R1", 10, 20, 20, 24, 0.955, 0), 4: ("Q4", 10, 43, 12, 46, 0.0, 90)}
    raw = spark.createDataFrame([(0, -3.0, 5.0, 10.0, 4.0, 0.9), (1, 200.0, 5.0, 10.0, 4.0, 0.9), (2, 50.0, 5.0, 10.0, 4.0, 0.1)], "k int, x double, y double, width double, height double, confidence double")
    raw = raw.withColumns({"page_width": F.lit(100), "page_height": F.lit(50)})
    assert [(r.k, r.x0, r.y0, r.x1, r.y1) for r in readings.detections(raw, 0.35).collect()] == [(0, 0, 3, 2, 7)]
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "content string").withColumn("key", readings.key(F.col("content"), "m", "s"))
    assert all(len(r.key) == 16 for r in asked.collect())
    cache = asked.where("content = 'b'").select("key")
    assert [r.content for r in readings.unanswered(asked, cache).collect()] == ["a"]


def test_scores_from_files_and_commands(spark, tmp_path, capsys):
    from wireloom.__main__ import main
    from wireloom.plans import evaluate

    box = lambda k: [50 * k, 0, 50 * k + 40, 30]
    symbol = lambda i, t, k, c=(): {"id": i, "type": t, "coordinates": box(k), "connections": list(c)}
    files = {
        "gold/D1.json": {"_connectivity_verified": True, "symbols": [symbol("R1", "R", 0, ["C1"]), symbol("C1", "C", 1), symbol("L1", "L", 2, ["R1"]), symbol("X", "X", 9)]},
        "gold/D2.json": {"symbols": [{"id": "A", "type": "R", "coordinates": box(0)}]},
        "gold/D3.json": {"symbols": []},
        "pred/D1.json": {"symbols": [symbol("a", "R", 0, ["b"]), symbol("b", "L", 1, ["c"]), symbol("c", "L", 2), symbol("z", "R", 20)]},
        "pred/D2.json": {"symbols": [symbol("q", "R", 0, ["q"])]},
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(data, indent=1))
    found = evaluate.from_files(spark, f"{tmp_path}/gold", f"{tmp_path}/pred")
    scores = {r.scope: (r.tp, r.fp, r.fn, r.correct) for r in found["detection"].collect()}
    assert scores == {"D1": (3, 1, 1, 2), "D2": (1, 0, 0, 1), "TOTAL": (4, 1, 1, 3)}
    assert [tuple(r)[:4] for r in found["connectivity"].where("scope = 'TOTAL'").collect()] == [("TOTAL", 1, 1, 1)]
    assert [(r.gold_type, r.pred_type, r.n) for r in found["confusions"].collect()] == [("C", "L", 1)]
    assert [r.drawing_id for r in found["missing"].collect()] == ["D3"]
    assert [r.id for r in found["unmatched_golden"].collect()] == ["X"] and [r.id for r in found["unmatched_predicted"].collect()] == ["z"]
    main(["domains"])
    assert capsys.readouterr().out.split() == ["electronic", "pid"]
    main(["eval", f"{tmp_path}/gold", f"{tmp_path}/pred"])
    assert "TOTAL" in capsys.readouterr().out


def page(*more):
    """Wires from the left and right to a coil, and a loose stroke."""
    picture = np.full((120, 200), 255, np.uint8)
    picture[60:62, 5:62] = 0
    picture[60:62, 100:150] = 0
    for x in range(62, 100, 6):
        picture[50:72, x : x + 2] = 0
    picture[50:52, 62:100] = 0
    picture[70:72, 62:100] = 0
    picture[52:60, 62:70] = 0
    picture[110:112, 20:60] = 0
    return picture


def test_pictures_to_json(spark, tmp_path, capsys):
    """Detections, evidence, specialists, templates, text, nets, findings and JSON in one plan; the expected values follow from how the page is drawn."""
    from wireloom.plans import interpret

    picture = page()
    box = {"x0": 60, "y0": 48, "x1": 102, "y1": 74}
    other = {"x0": 150, "y0": 50, "x1": 180, "y1": 72}
    picture[50:72, 150:180] = 0  # a solid block at the end of the right wire
    png(tmp_path / "pages/D1.png", picture)
    png(tmp_path / "pages/D2.png", np.full((30, 30), 255, np.uint8))
    png(tmp_path / "lib/Inductor/coil.png", picture[48:74, 60:102])
    png(tmp_path / "lib/Load/block.png", picture[50:72, 150:180])
    (tmp_path / "lib/Inductor/coil.terminals.json").write_text('[{"name": "1", "point": [0, 13], "body": [5, 13]}, {"name": "2", "point": [41, 13], "body": [36, 13]}]')
    images = drawings.images(spark, str(tmp_path / "pages"))
    tokens = spark.createDataFrame([("D1", 0, "L7 10uH", 70, 30, 95, 40, 0.9, 0), ("D1", 1, "OHM", 0, 0, 9, 9, 0.9, 0)], interpret.TOKENS)
    detect = lambda g: [b | {"kind": "symbol", "class": k, "confidence": p, "source": "synthetic_yolo"} for b, k, p in ((box, "Inductor", 0.5), (other, None, None))] if g.shape[1] == 200 else []
    embed = interpret.averages()
    lib = library.built(spark, str(tmp_path / "lib"), str(tmp_path / "cache"), embed, "averages")
    assert lib.count() == 16 and library.built(spark, str(tmp_path / "lib"), str(tmp_path / "cache"), None, "averages").count() == 16
    given = interpret.Given(tokens=tokens, detect=detect, library=lib, terminals=library.ends(spark, str(tmp_path / "lib")), embed=embed)
    found = interpret.interpret(spark, images, Config(), given)
    symbols = {r.idx: r for r in found["symbols"].collect()}
    assert {k: (r.drawing_id, r.id, r["class"], r.value, r.label_source) for k, r in symbols.items()} == {0: ("D1", "L7", "Inductor", "10uH", "ocr"), 1: ("D1", "SYM_001", "Load", None, "classification")}
    # the detector's 1.2 x 0.5, the nearest picture's 1 and the label's 0.55
    assert abs(symbols[0].score - (0.6 + 1 + 0.55)) < 1e-6 and symbols[0].rotation == 0
    ends = {(r.id, r.idx): r for r in found["terminals"].collect()}
    assert (ends["L7", 0].x, ends["L7", 1].x, ends["L7", 0].source, ends["L7", 0].direction_deg) == (60, 102, "inferred", 180.0)
    assert ends["L7", 1].net_id == ends["SYM_001", 0].net_id != ends["L7", 0].net_id
    sheets_ = {r.drawing_id: json.loads(r.json) for r in found["json"].collect()}
    assert sheets_["D2"] == {"symbols": []}
    assert [(s["id"], s["type"], s["coordinates"], s["connections"]) for s in sheets_["D1"]["symbols"]] == [("L7", "Inductor", [60, 48, 102, 74], ["SYM_001"]), ("SYM_001", "Load", [150, 50, 180, 72], ["L7"])]
    # the left wire ends in one terminal, the loose stroke in none
    assert sorted((r.kind, r.object_id) for r in found["findings"].collect()) == [("single_terminal", ends["L7", 0].net_id), ("single_terminal", max(r.net_id for r in found["nets"].collect()))]
    assert {r.drawing_id: r.domain for r in found["routes"].collect()} == {"D1": "electronic", "D2": "electronic"}
    assert {"route", "localize", "classify", "wires", "output"} <= set(found["timings"]) and all(round(t, 4) == t for t in found["timings"].values())


def test_run_and_build_commands(spark, tmp_path, capsys):
    from wireloom.__main__ import main

    png(tmp_path / "pages/D1.png", page())
    png(tmp_path / "lib/Coil/c.png", page()[48:74, 60:102])
    main(["run", str(tmp_path / "pages"), str(tmp_path / "out"), "--library", str(tmp_path / "lib")])
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["drawings"] == 1 and told["symbols"] >= 1 and all(isinstance(v, float) for v in told["timing"].values())
    written = {r.drawing_id: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/json")).collect()}
    assert written["D1"]["symbols"]
    assert spark.read.text(str(tmp_path / "out/overlays")).first().value.startswith("<svg")
    main(["build-library", str(tmp_path / "lib"), str(tmp_path / "cache")])
    assert capsys.readouterr().out.split()[-2:] == ["8", "entries"]


def test_second_detector_and_answers(spark, tmp_path, caplog, monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from wireloom.sources import detectors
    from wireloom.sources.domains import Detector

    asked = []

    class Host(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            text = b'{"predictions": [{"x": 5, "y": 5, "width": 6, "height": 4, "confidence": 0.5}, {"x": -9, "y": 0, "width": 2, "height": 2}]}'
            self.send_response(200 if self.headers["Authorization"] == "Bearer k" else 403)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *a):
            pass

    host = HTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=host.serve_forever, daemon=True).start()
    spec, at = Detector("hosted", "w/p/2", 0.3, 0.4), f"http://127.0.0.1:{host.server_address[1]}/"
    found = detectors.hosted(spec, at, "k")(np.zeros((20, 30), np.uint8))
    assert [(b["x0"], b["y0"], b["x1"], b["y1"], b["class"], b["confidence"]) for b in found] == [(2, 3, 8, 7, None, 0.5)] and asked[0]["model"] == "w/p/2"
    for _ in range(2):
        assert detectors.hosted(spec, at, "wrong")(np.zeros((2, 3), np.uint8)) == []
    host.shutdown()
    assert len([r for r in caplog.records if "w/p/2" in r.message]) == 1
    monkeypatch.delenv(detectors.URL, raising=False)
    monkeypatch.chdir(tmp_path)
    assert detectors.hosted(Detector("hosted", "m"))(np.zeros((2, 3), np.uint8)) == []
    (tmp_path / ".env").write_text("# no\nA = b=c\nbad\n")
    assert detectors.environment() == {"A": "b=c"}
    own = lambda g: []
    assert detectors.provided(Detector("local", "m"), {"m": own}) is own and detectors.provided(None) is None and detectors.provided(Detector("x", "m")) is None
    (tmp_path / "share/tessdata").mkdir(parents=True)
    (tmp_path / "share/tessdata/eng.traineddata").touch()
    monkeypatch.delenv("TESSDATA_PREFIX", raising=False)
    assert detectors.reading_data(str(tmp_path)) == str(tmp_path / "share/tessdata") and detectors.reading_data("/none") is None
    calls = []

    def answer(df):
        rows = df.collect()
        calls.append(len(rows))
        return spark.createDataFrame([(r.key, r.key * 2) for r in rows], "key string, said string")

    for rows, new in ((["a", "a", "b"], 2), (["b", "c"], 1), (["a"], 0)):
        got = detectors.answered(spark, spark.createDataFrame([(r,) for r in rows], "key string"), str(tmp_path / "answers"), answer)
        assert sorted((r.key, r.said) for r in got.collect()) == [(r, r * 2) for r in sorted(set(rows))] and calls[-1] == new


def test_server(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from wireloom import server

    serving = server.server(lambda body: server.process(spark, body, Config()), 0)
    threading.Thread(target=serving.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{serving.server_address[1]}/api/process"
    png(tmp_path / "p.png", page())
    with urllib.request.urlopen(urllib.request.Request(at, (tmp_path / "p.png").read_bytes()), timeout=300) as answer:
        said = json.load(answer)
    assert said["domain"] == "electronic" and said["json"]["symbols"] and said["overlay"].startswith("data:image/svg+xml;base64,")
    assert server.numeric({"a": 1, "b": "x", "c": 0.5, "d": True}) == {"a": 1, "c": 0.5}
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(at, b"no picture"), timeout=300)
    assert e.value.code == 500 and json.load(e.value)["error"].startswith("ValueError: ")
    serving.shutdown()


def test_sheets(spark):
    from wireloom.sinks import sheets

    rows = [(1, k, f"S{k}", t, 10 * k, 0, 10 * k + 5, 5) for k, t in enumerate(["R", "C", "Unknown", "R", "<L>"])]
    symbols = spark.createDataFrame(rows, "drawing_id int, idx int, id string, type string, x0 int, y0 int, x1 int, y1 int")
    assert {r.id: r.colour for r in sheets.coloured(symbols).collect()} == {"S4": sheets.PALETTE[0], "S1": sheets.PALETTE[1], "S0": sheets.PALETTE[2], "S3": sheets.PALETTE[2], "S2": sheets.RED}
    edges = spark.createDataFrame([(1, "S0", "S1"), (1, "S1", "S0"), (1, "S3", "S4"), (1, "S4", "S1"), (1, "S2", "S2")], "drawing_id int, a string, b string")
    parts = {r.id: (r.part, r["size"]) for r in sheets.components(symbols, edges).collect()}
    assert parts == {"S0": (0, 4), "S1": (0, 4), "S3": (0, 4), "S4": (0, 4), "S2": (1, 1)}
    at = {r.id: (r.x, r.y) for r in sheets.laid_out(sheets.components(symbols, edges)).collect()}
    assert at["S2"] == (360.0, 120.0) and len(set(at.values())) == 5
    import xml.etree.ElementTree as ET

    drawn = ET.fromstring(sheets.graphs(symbols, edges).first().svg)
    assert [len(drawn.findall(f"{{http://www.w3.org/2000/svg}}{t}")) for t in ("line", "circle")] == [3, 5]
    pages = spark.createDataFrame([(1, 80, 20), (2, 5, 5)], "drawing_id int, width int, height int")
    svg = {r.drawing_id: ET.fromstring(r.svg) for r in sheets.overlays(symbols, pages).collect()}
    assert len(svg[1]) == 10 and len(svg[2]) == 0 and svg[1][9].text == "S4 <L>"
    html = sheets.pages(symbols, edges, spark.createDataFrame([(1, '{"id":"a<b"}')], "drawing_id int, json string")).first().html
    assert "<tr><td>S1</td><td>C</td><td>2</td></tr>" in html and "<b>&quot;id&quot;</b>" in html and "a&lt;b" in html


def test_packs_from_files(tmp_path, spark):
    (tmp_path / "packs/tubes").mkdir(parents=True)
    (tmp_path / "packs/tubes/pack.yaml").write_text("designators_path: t.yaml\nrouter_keywords: [anode]\nevidence_weights: {yolo: 2}\nreal_detector: {provider: local, model_id: m.pt, conf: 0.2}\nreference_dir: pictures\n")
    (tmp_path / "packs/tubes/t.yaml").write_text("designators:\n  v: {Tube: 0.75, Valve: 0.25}\npart_number_families:\n  - {pattern: 'EL8[34]', class: Tube}\n")
    (tmp_path / "packs/flat.json").write_text('{"designators": {"X": {"Thing": 1}}, "specialists": [{"name": "own", "classes": ["Thing"]}]}')
    assert domains.listed(tmp_path / "packs") == ["electronic", "flat", "pid", "tubes"]
    pack = domains.load("tubes", tmp_path / "packs")
    assert pack.prefixes == {"V": {"Tube": 0.75, "Valve": 0.25}} and pack.families == [("EL8[34]", "Tube")] and pack.keywords == ["ANODE"]
    assert (pack.weights["yolo"], pack.weights["dinov2"]) == (2.0, 1.0) and pack.detector.conf == 0.2 and pack.paths["reference_dir"] == str(tmp_path / "packs/tubes/pictures")
    assert [tuple(r) for r in domains.prefix_table(spark, pack).collect()] == [("V", 0, "Tube", 0.75), ("V", 1, "Valve", 0.25)]
    assert domains.load("flat", tmp_path / "packs").groups == [("own", ["Thing"])]
    with pytest.raises(ValueError, match="electronic, pid"):
        domains.load("none")
    assert len(domains.load("electronic").prefixes) == 21 and len(domains.load("pid").prefixes) == 52 and len(domains.load("electronic").families) == 15


def test_config_in_blocks(tmp_path):
    (tmp_path / "c.yaml").write_text("domain: pid\nwires: {terminal_directional_reach: 45, unknown: 1}\nclassify:\n  rotations: [0, 180]\n  mirror: false\npreprocess:\noutput: {outputs_dir: o}\n")
    assert Config.load(str(tmp_path / "c.yaml")) == Config(domain="pid", snap_reach=45, turns=(0, 180), mirror=False, outputs="o")
    (tmp_path / "c.json").write_text('{"mirror": 3}')
    with pytest.raises(TypeError):
        Config.load(str(tmp_path / "c.json"))


def test_level_crop_and_colour():
    yy, xx = np.mgrid[:200, :300]
    for degrees in (-4.0, 0.0, 2.5, 4.5):
        a = np.radians(degrees)
        u, v = np.cos(a) * (xx - 150) + np.sin(a) * (yy - 100), -np.sin(a) * (xx - 150) + np.cos(a) * (yy - 100)
        mask = (abs(u) < 100) & (abs(v) < 50)
        assert abs(raster.skew(mask) - degrees) < 0.6
        level, by = raster.deskewed(mask)
        assert (by == 0) == (degrees == 0) and abs(raster.skew(level)) < 0.6
    assert raster.skew(np.zeros((9, 9), bool)) == 0.0
    tilted = np.abs(xx - yy) < 20
    assert raster.deskewed(tilted)[1] == 0.0  # too far
    picture = np.arange(20, dtype=np.uint8).reshape(4, 5)
    assert raster.crop(picture, 1, 1, 3, 2).tolist() == [[6, 7]] and raster.crop(picture, -5, -5, 1, 1).tolist() == [[0]] and raster.crop(picture, 9, 9, 12, 12).size == 0
    ink = np.array([[[255, 0, 0], [0, 0, 255], [0, 255, 0], [10, 10, 10], [200, 120, 100]]], np.uint8)
    assert raster.blue(ink).tolist() == [[True, False, False, False, True]] and not raster.blue(ink[..., 0]).any()
    flat = np.full((4, 6), 77, np.uint8)
    assert (raster.enlarged(flat, 3) == 77).all() and raster.enlarged(flat, 3).shape == (12, 18)
    ramp = raster.enlarged(np.tile(np.arange(0, 200, 10, dtype=np.uint8), (3, 1)), 3)[4]
    assert (np.diff(ramp[12:-12].astype(int)) >= 0).all()


def test_circles_rectangles_and_arrowheads(spark):
    canvas = np.full((80, 80), 255, np.uint8)
    raster.arc(canvas, 40, 38, 25, 2)
    ring = raster.circle(canvas < 128)
    assert ring and max(abs(ring[0] - 40), abs(ring[1] - 38), abs(ring[2] - 25)) <= 1
    body = np.full((80, 40), 255, np.uint8)
    raster.line(body, [(12, 15), (28, 15), (28, 65), (12, 65), (12, 15)], 2)
    assert raster.circle(body < 128) is None and raster.rectangular(body < 128) and not raster.rectangular(canvas < 128)
    assert specialists.shapes(canvas) == {"circle": True, "rectangle": False} and specialists.shapes(body) == {"circle": False, "rectangle": True} and specialists.shapes(body[:9]) is None
    yy, xx = np.mgrid[:80, :80]
    for out, want in ((True, "BJT_NPN"), (False, "BJT_PNP")):
        picture = canvas.copy()
        head = (xx - 44) if out else (56 - xx)  # a triangle along the x axis
        picture[(head >= 0) & (head <= 12) & (np.abs(yy - 38) <= (12 - head) / 2)] = 0
        assert specialists.transistor(picture) == (want, 0.6)
    assert specialists.transistor(body) is None
    crops = spark.createDataFrame([(1, 80, 80, bytearray(canvas.tobytes())), (2, 80, 40, bytearray(body.tobytes())), (3, 80, 40, bytearray(body.tobytes()))], "k int, height int, width int, data binary")
    routes = spark.createDataFrame([(1, "bjt_potentiometer"), (2, "bjt_potentiometer"), (3, "own")], "k int, route string")
    own = {"own": lambda: F.array(F.struct(F.lit("Box").alias("class"), F.lit(1.0).alias("score"), F.lit(0.5).alias("confidence")))}
    got = sorted((r.k, r.source, r["class"], r.score, r.confidence) for r in specialists.opinions(crops, routes, ["k"], says=own).collect())
    assert got == [(1, "geometry:bjt_potentiometer", "BJT_NPN", 0.5, 0.75), (1, "geometry:bjt_potentiometer", "BJT_PNP", 0.5, 0.75), (2, "geometry:bjt_potentiometer", "Potentiometer", 1.0, 0.6), (3, "geometry:own", "Box", 1.0, 0.5)]


def test_kicad_pictures(spark, tmp_path):
    from wireloom.sources import kicad

    (tmp_path / "a.kicad_sym").write_text('(kicad_symbol_lib (symbol "A" (rectangle (start -1 -1) (end 1 1)) (circle (center 0 0) (radius 0.5)) (pin passive line (at -2 0 0) (length 1) (number "1")) (polyline (pts (xy 0 1) (xy 0 2))) (arc (start 1 0) (mid 1.5 0.5) (end 2 0))) (symbol "Empty"))')
    (tmp_path / "b.kicad_sym").write_text('(kicad_symbol_lib (symbol "B" (arc (start 0 0) (mid 1 0) (end 2 0))))')
    parts = kicad.symbols(spark, str(tmp_path))
    assert kicad.symbols(spark, str(tmp_path / "b.kicad_sym")).count() == 1 and parts.count() == 6  # two reads in one session
    found = {r.symbol: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in kicad.pictures(parts).collect()}
    a = found["A"]
    assert a.shape == (60 + 24, 80 + 24)
    on = lambda x, y: a[int((2 - y) * 20) + 12, int((x + 2) * 20) + 12]
    assert all(on(*p) == 0 for p in ((-1, 0.5), (1, 1), (0, -1), (-1.5, 0), (0, 1.5), (0.5, 0), (0, 0.5), (1.5, 0.5))) and all(on(*p) == 255 for p in ((0, 0.2), (0.8, -0.5), (1.5, -0.5), (-1.5, 0.5)))
    assert (found["B"] == 0).sum() >= 40


def test_reader_is_asked_in_each_turn_and_mode(spark):
    """A reader that finds the dark block of a page; its box comes back to the upright page of the usual size."""
    picture = np.full((30, 50, 1), 255, np.uint8)
    picture[4:10, 20:40] = 0
    images = spark.createDataFrame([("D", 30, 50, 1, bytearray(picture.tobytes()))], "drawing_id string, height int, width int, channels int, data binary")

    def reader(page, mode):
        ys, xs = np.nonzero(page < 128)
        return [{"text": f"{mode}{page.shape[0] > page.shape[1]}", "conf": 80, "left": int(xs.min()), "top": int(ys.min()), "width": int(np.ptp(xs)) + 1, "height": int(np.ptp(ys)) + 1}] if mode != "none" else []

    found = pictures.read(images, reader, Config(reading_modes=("a", "none"))).collect()
    assert sorted((r.text, r.orientation, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in found) == [("aFalse", 0, 20, 4, 40, 10, 0.8), ("aTrue", 90, 20, 4, 40, 10, 0.8), ("aTrue", 270, 20, 4, 40, 10, 0.8)]
