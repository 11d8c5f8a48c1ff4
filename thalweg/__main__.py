"""Run segmentation setups over tables on disk: python -m thalweg --reaches ... --nodes ... --out ..."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import SETUPS, Setting, needs_geometry
from .operators import centerline, geometry, graph, profile, windows
from .plans import runner
from .sources import readers, sinks


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="thalweg", description=__doc__)
    p.add_argument("--reaches", required=True)
    p.add_argument("--nodes", required=True)
    p.add_argument("--project", action="store_true", help="node coordinates are degrees")
    p.add_argument("--observations", help="folder of observations, for heights")
    p.add_argument("--continent", default="")
    p.add_argument("--paths", help="path ids as JSON or text; all if not given")
    p.add_argument("--paths-file", help="a file of path ids")
    p.add_argument("--setups", nargs="*", default=[s.name for s in SETUPS])
    p.add_argument("--gap", type=float, default=160.0, help="metres over which line ends are joined")
    p.add_argument("--resume", action="store_true", help="use the tuning that an earlier run left in --out")
    p.add_argument("--csv", action="store_true", help="write CSV beside Parquet")
    p.add_argument("--out", required=True)
    return p.parse_args(argv)


def earlier(spark: SparkSession, folder: str) -> dict | None:
    """Family, settings and threshold that an earlier tuning chose."""
    try:
        row = json.loads(readers.resume(spark, folder, ["choice"])["choice"].first()["value"])
    except FileNotFoundError:
        return None
    return {"family": row["family"], "settings": tuple(Setting(**s) for s in row["settings"]), "threshold_m": row["threshold_m"]}


def run(spark: SparkSession, argv: list[str] | None = None) -> list[str]:
    """Do what the arguments say; returns the folders that were written."""
    a = arguments(argv)
    made: list[str] = []

    def write(tables: dict, folder: str) -> None:
        made.extend(f"{folder}/{n}" for n in sinks.write_tables(tables, folder))
        if a.csv:
            sinks.write_tables(tables, f"{folder}/csv", csv=True)

    reaches = readers.normalize_reaches(readers.read_table(spark, a.reaches))
    ids = "\n".join(r["value"] for r in spark.read.text(a.paths_file).collect()) if a.paths_file else a.paths
    if ids:
        reaches = reaches.where(F.col("main_path_id").isin(readers.parse_ids(ids)))
    nodes = profile.semi(readers.normalize_nodes(readers.read_table(spark, a.nodes), a.project), reaches, "reach_id")
    if a.observations:
        nodes = profile.with_heights(nodes, profile.node_heights(readers.read_observations(spark, a.observations, a.continent), reaches))
    added = graph.enrichment(reaches, nodes.withColumnRenamed("n_channels", "n_chan_mod"))
    main_reaches = profile.mainstem(reaches).select("reach_id", F.col("main_path_id").alias("mip"))
    rich = profile.enrich_nodes(nodes, added).join(main_reaches, "reach_id").withColumn("width", F.col("multi_width")).withColumn("n_channels", F.col("multi_n_chan"))
    steps = runner.Metrics()
    with steps.step("prepare_nodes"):
        paths = runner.settle(steps.watch(profile.order_nodes(rich), "nodes", rows=F.count("*"), without_width=F.count_if(F.col("width").isNull())))
    write({"distance_faults": profile.distance_faults(paths)}, a.out)
    external = None
    setups = [s for s in SETUPS if s.name in set(a.setups)]
    if any(needs_geometry(st.features) for s in setups for st in s.stages):
        lines = runner.settle(centerline.merge_mainpaths(reaches, a.gap))
        turned = geometry.orient(lines.select(F.col("main_path_id").alias("mip"), "line"), paths)
        write({"centerlines": lines, "line_faults": centerline.line_faults(lines, reaches), "orientation": turned.drop("line")}, a.out)
        with steps.step("geometry_features"):
            external = runner.settle(steps.watch(geometry.geometry_features(paths, turned, windows.plan_windows(paths)), "geometry", rows=F.count("*")))
    tuned: dict = {}
    for s in setups:
        for stage in s.stages:
            if stage.name in tuned:
                continue
            folder = f"{a.out}/tuning/{stage.name}"
            known = earlier(spark, folder) if a.resume else None
            tuned[stage.name] = t = runner.run_stage(paths, stage, external=external, known=known)
            if known is None:
                write(runner.tuning_tables(t), folder)
                facts = {"family": t["family"], "settings": [asdict(x) for x in t["settings"]], "threshold_m": t["threshold_m"], "decision": t["analysis"]["choice"]}
                spark.createDataFrame([(json.dumps(facts, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/choice")
                made.append(f"{folder}/choice")
        done = runner.run_setup(paths, s, external=external, tuned=tuned)
        write(runner.final_tables(done.get("final", done)), f"{a.out}/{s.name}")
        if "skipped" in done and "final" not in done:
            write({"skipped_segments": done["skipped"]}, f"{a.out}/{s.name}")
            write({k: done["second"][k] for k in ("consensus", "selections", "break_faults", "stable")}, f"{a.out}/{s.name}/second")
    facts = {"arguments": vars(a), "stages": {n: {"family": t["family"], "threshold_m": t["threshold_m"], "seconds": {k: v + t["seconds"].get(k, 0.0) for k, v in steps.seconds.items()} | {k: v for k, v in t["seconds"].items() if k not in steps.seconds}, "counts": steps.counts() | t["metrics"].counts()} for n, t in tuned.items()}, "written": made}
    sinks.write_json(spark, facts, f"{a.out}/manifest")
    return [*made, f"{a.out}/manifest"]


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("thalweg").getOrCreate()
    run(spark, argv)
    spark.stop()


if __name__ == "__main__":
    main()
