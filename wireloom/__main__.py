"""Commands: run IMAGES OUT, eval GOLDEN PREDICTED, boxes IMAGES OUT, nets IMAGES SYMBOLS OUT, build-library PICTURES OUT, library PICTURES, domains, serve."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wireloom")
    parser.add_argument("--config", help="a YAML or JSON file of settings")
    parser.add_argument("--packs", help="a folder of domain packs")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about, *arguments in (
        ("run", "interpret pictures: netlists as JSON, graphs, pages, overlays and findings", "images", "out"),
        ("eval", "score predicted drawings against golden ones", "golden", "predicted"),
        ("boxes", "propose boxes for pictures, as netlists without connections", "images", "out"),
        ("nets", "trace the wires between symbols (drawings as JSON) in pictures", "images", "symbols", "out"),
        ("build-library", "embed a folder of reference pictures in all variants, unless the table at OUT is up to date", "pictures", "out"),
        ("library", "digest of a folder of reference pictures", "pictures"),
        ("domains", "what domains there are"),
        ("serve", "answer pictures posted to /api/process"),
    ):
        command = commands.add_parser(name, help=about)
        for a in arguments:
            command.add_argument(a)
        if name == "run":
            command.add_argument("--tokens", help="a Parquet table of readings")
            command.add_argument("--library", help="a folder of reference pictures with their terminals")
        if name == "serve":
            command.add_argument("--port", type=int, default=8000)
    given = parser.parse_args(words)
    from wireloom import server
    from wireloom.config import Config
    from wireloom.plans import evaluate, interpret, pictures
    from wireloom.shipping import ship
    from wireloom.sinks import netlists, sheets
    from wireloom.sources import domains, drawings, library

    if given.command == "domains":
        print("\n".join(domains.listed(given.packs)))
        return
    spark = SparkSession.builder.appName("wireloom").getOrCreate()
    ship(spark)
    settings = Config.load(given.config)
    embed = interpret.averages()
    if given.command == "run":
        known = {}
        if given.library:
            entries = library.entries(spark, given.library, embed, settings.turns, settings.mirror)
            known = {"library": entries, "embed": embed, "terminals": library.ends(spark, given.library)}
        tokens = spark.read.parquet(given.tokens) if given.tokens else None
        images = drawings.images(spark, given.images)
        found = interpret.interpret(spark, images, settings, interpret.Given(tokens=tokens, packs=given.packs, **known))
        out = given.out.rstrip("/")
        symbols = found["symbols"].withColumn("type", F.col("class"))
        edges = found["connections"].select("drawing_id", F.col("symbol_id").alias("a"), F.explode("connections").alias("b"))
        began = time.perf_counter()
        netlists.write_each(found["json"], "json", f"{out}/json")
        netlists.write_each(found["graph"], "xml", f"{out}/graphml")
        netlists.write_each(sheets.overlays(symbols, images.select("drawing_id", "width", "height")), "svg", f"{out}/overlays")
        netlists.write_each(sheets.pages(symbols, edges, found["json"]), "html", f"{out}/pages")
        found["findings"].write.mode("overwrite").parquet(f"{out}/findings")
        timings = found["timings"] | {"write": round(time.perf_counter() - began, 4)}
        print(json.dumps({"drawings": found["json"].count(), "symbols": found["symbols"].count(), "nets": found["nets"].count(), "timing": server.numeric(timings)}))
    elif given.command == "eval":
        for name, df in evaluate.from_files(spark, given.golden, given.predicted).items():
            print(name)
            df.orderBy(*df.columns[:2]).show(1000, truncate=False)
    elif given.command == "boxes":
        found = pictures.boxes(drawings.images(spark, given.images), settings)
        rows = found.select("drawing_id", "idx", F.format_string("SYM_%03d", "idx").alias("id"), F.coalesce("class", F.lit("Unknown")).alias("type"), "x0", "y0", "x1", "y1", F.array().cast("array<string>").alias("connections"))
        netlists.write_each(netlists.netlists(rows), "json", given.out)
    elif given.command == "nets":
        symbols = drawings.symbols(drawings.drawings(spark, given.symbols))
        pictures.nets(drawings.images(spark, given.images), symbols, settings).select("drawing_id", "net_id", "node.*").write.mode("overwrite").parquet(given.out)
    elif given.command == "build-library":
        print(library.built(spark, given.pictures, given.out, embed, "averages", settings.turns, settings.mirror).count(), "entries")
    elif given.command == "serve":
        serving = server.server(lambda body: server.process(spark, body, settings, interpret.Given(packs=given.packs)), given.port)
        print(f"listening on {serving.server_address[1]}")
        serving.serve_forever()
    else:
        print(library.signature(library.files(spark, given.pictures), "none"))


if __name__ == "__main__":
    main()
