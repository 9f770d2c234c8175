"""A thin command line: mask, restore, sessions, status, exec, run, shell-init. Vault and sessions are folders of versions under --vault.

exec and run take a command behind --: exec masks its arguments first, and both put originals back into the files that
the command has changed. shell-init prints shell functions that send the tools it is given through exec.
"""

from __future__ import annotations

import argparse
import os
import re
import shlex
import subprocess
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.expr import empty
from veilframe.operators import detect as layers
from veilframe.operators import vault as vaults
from veilframe.plans import engine
from veilframe.sources.changed import Options, changed_files, changed_or_staged, load_options, newly_changed
from veilframe.sources.readers import segments, text_documents
from veilframe.sources.writers import edits_of, rewrite_files, splice_files


def _latest(spark: SparkSession, folder: str, kind: str, schema: str) -> tuple[DataFrame, int]:
    """The newest version of a table, and its number."""
    path = os.path.join(folder, kind)
    numbers = sorted(int(x[2:]) for x in os.listdir(path) if x.startswith("v=")) if os.path.isdir(path) else []
    numbers = [n for n in numbers if os.path.exists(os.path.join(path, f"v={n}", "_SUCCESS"))]
    if not numbers:
        return spark.createDataFrame([], schema), -1
    return spark.read.schema(schema).parquet(os.path.join(path, f"v={numbers[-1]}")), numbers[-1]


def _keep(table: DataFrame, folder: str, kind: str, number: int) -> None:
    table.write.parquet(os.path.join(folder, kind, f"v={number}"))


def _write(files: DataFrame, restored: bool) -> list[str]:
    out = []
    for row in files.withColumn("to", engine.output_path(F.regexp_replace("path", "^file:(//)?", ""), restored)).toLocalIterator():
        with open(row["to"], "wb") as f:
            f.write(row["content"])
        out.append(row["to"])
    return out


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, text, format and segs of files: their segments, and where these stand in the text they make together."""
    rows = segments(spark, *paths).withColumn("cell", F.col("metadata")["cell"]).withColumn("part", F.col("metadata")["part"])
    docs = rows.groupBy(F.col("path").alias("doc_id"), "format").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text", "location", "start_offset", "part", "cell"))).alias("s"))
    kind = "struct<seg_no:int,text:string,location:string,start_offset:int,part:string,cell:string,joined_start:int,joined_end:int>"

    def step(acc, x):
        end = acc["at"] + F.length(x["text"])
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(x.withField("joined_start", acc["at"]).withField("joined_end", end))).alias("out"))

    placed = F.aggregate("s", F.struct(F.lit(0).alias("at"), empty(kind).alias("out")), step, lambda acc: acc["out"])
    return docs.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"), "format", placed.alias("segs"))


def _found(docs: DataFrame, name: str, options: Options) -> DataFrame:
    """docs with spans. A registered model sees the rows of sheets as lines."""
    if name == "hybrid" and layers.MODELS:
        model = layers.LAYERS[next(n for n in layers.registered() if n in layers.MODELS)]
        cells = docs.select("doc_id", F.explode("segs").alias("x")).filter("x.cell is not null").select("doc_id", "x.part", "x.cell", "x.text", F.col("x.joined_start").alias("start_offset"), F.col("x.joined_end").alias("end_offset"))
        return engine.detect_documents(docs, cells, model, options.safe, options.strict_names)
    return engine.detect(docs, name, options.safe, options.strict_names)


def mask(spark: SparkSession, paths: list[str], folder: str, project: str, name: str, dry: bool, options: Options = Options()) -> list[str]:
    """Writes masked copies of files: each find is masked where it stands, and nowhere else."""
    vault, number = _latest(spark, folder, "mappings", vaults.MAPPINGS)
    sessions, last = _latest(spark, folder, "sessions", vaults.SESSIONS)
    found = _found(_documents(spark, paths), name, options)
    masked, after = engine.mask(found, F.lit(project), vault)
    if dry:
        engine.preview(engine.analysis(found)).show(20, False)
        return []
    made = F.coalesce("replacements", F.array().cast("array<struct<start:int,end:int,original:string,masked:string>>"))
    edits = masked.select(F.col("doc_id").alias("path"), edits_of(F.col("segs"), made, F.col("format").isin("text", "markdown")).alias("edits"))
    out = _write(splice_files(_files(spark, paths).join(edits, "path")), False)
    _keep(after, folder, "mappings", number + 1)
    row = engine.session(masked.withColumn("path", F.col("doc_id")), uuid.uuid4().hex[:8], project, engine.stats_by_type(found), F.current_timestamp())
    row = row.withColumn("output_files", F.array(*[F.lit(x) for x in out]).cast("array<string>")).withColumn("stats", F.col("stats").cast("map<string,bigint>"))
    _keep(sessions.unionByName(row.select(*sessions.columns)), folder, "sessions", last + 1)
    return out


def masked_arguments(spark: SparkSession, arguments: list[str], folder: str, project: str, name: str, keep: bool) -> list[str]:
    """A command's arguments with what is found in them masked; flags and what is not worth a look stay. The vault is kept if asked."""
    vault, number = _latest(spark, folder, "mappings", vaults.MAPPINGS)
    rows = spark.createDataFrame(list(enumerate(arguments)), "doc_id int, text string")
    worth = engine.maskable_argument(F.col("text"))
    masked, after = engine.mask(engine.detect(rows.filter(worth), name), F.lit(project), vault)
    new = {r["doc_id"]: r["masked_text"] for r in masked.collect()}
    if keep and new:
        _keep(after, folder, "mappings", number + 1)
    return [new.get(k, x) for k, x in enumerate(arguments)]


def put_back(spark: SparkSession, paths: list[str], folder: str, project: str) -> dict:
    """Puts a project's originals back into text files, in place: files, ok, failed, changes, errors."""
    vault, _ = _latest(spark, folder, "mappings", vaults.MAPPINGS)
    sizes = spark.createDataFrame([(p, os.path.getsize(p) if os.path.isfile(p) else None) for p in paths], "path string, size long")
    verdicts = {r["path"]: r["v"] for r in sizes.select("path", engine.file_verdict(F.col("path"), F.col("size")).alias("v")).collect()}
    results = [(p, False, 0, v) for p, v in verdicts.items() if v != "ok"]
    good = [p for p, v in verdicts.items() if v == "ok"]
    if good:
        texts = text_documents(spark, *good).select(F.col("path").alias("doc_id"), "text")
        for r in engine.restore_by_vault(texts, vault, project).filter("n_restored > 0").toLocalIterator():
            path = re.sub("^file:(//)?", "", r["doc_id"])
            with open(path, "w", encoding="utf-8", newline="") as f:
                f.write(r["restored_text"])
            results.append((path, True, r["n_restored"], None))
    done = spark.createDataFrame(results, "path string, ok boolean, changes long, error string")
    return engine.summary(done).first().asDict()


def run_command(spark: SparkSession, command: list[str], folder: str, project: str, root: str, name: str, mask_arguments: bool, dry: bool, restoring: bool = True) -> int:
    """Runs a command in root and puts originals back into the files that it has changed. Returns its exit code."""
    if mask_arguments:
        command = [command[0], *masked_arguments(spark, command[1:], folder, project, name, not dry)]
    print("command:", *command)
    if dry:
        return 0
    listed = lambda found: spark.createDataFrame([(x,) for x in found], "path string")
    before = listed(changed_or_staged(root))
    try:
        code = subprocess.run(command, cwd=root).returncode
    except FileNotFoundError:
        print(f"no such command: {command[0]}", file=sys.stderr)
        return 1
    if restoring:
        now = newly_changed(listed(changed_files(root)), listed(changed_files(root, True)), before)
        told = put_back(spark, sorted(r["path"] for r in now.collect()), folder, project)
        print(f"restored {told['changes']} mask(s) in {told['ok']} file(s)")
    return code


def shell_functions(tools: list[str]) -> str:
    """Shell functions that send each of the tools through exec."""
    return "\n".join(f'{t}() {{ command {shlex.quote(sys.executable)} -m veilframe exec -- {t} "$@"; }}' for t in tools if re.fullmatch(r"[A-Za-z][\w.-]*", t))


def restore(spark: SparkSession, paths: list[str], folder: str, project: str) -> list[str]:
    """Restores files with the mappings of the session that wrote them, else with those of the best session, else of the project."""
    vault, _ = _latest(spark, folder, "mappings", vaults.MAPPINGS)
    sessions, _ = _latest(spark, folder, "sessions", vaults.SESSIONS)
    out = []
    for path in paths:
        own = vaults.session_of_file(sessions.filter(F.col("project_id") == project), path).select("mappings").collect()
        if not own:
            best = vaults.best_session(_documents(spark, [path]), sessions.filter(F.col("project_id") == project)).join(sessions, "session_id").select("mappings").collect()
            own = best
        pairs = own[0]["mappings"] if own else {r["masked_text"]: r["original_text"] for r in vault.filter(F.col("project_id") == project).select("masked_text", "original_text").toLocalIterator()}
        known = spark.createDataFrame([(pairs,)], "pairs map<string,string>")
        out += _write(rewrite_files(_files(spark, [path]).crossJoin(known)), True)
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["mask", "restore", "sessions", "status", "exec", "run", "shell-init"])
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--vault", default=None)
    parser.add_argument("--project", default=None)
    parser.add_argument("--root", default=".", help="where a command runs")
    parser.add_argument("--engine", default=None)
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--no-restore", action="store_true")
    args = sys.argv[1:] if args is None else args
    cut = args.index("--") if "--" in args else len(args)
    given, command = parser.parse_args(args[:cut]), args[cut + 1 :]
    if given.command == "shell-init":
        print(shell_functions([*given.paths, *command]))
        return 0
    root = os.path.abspath(given.root)
    options = load_options(root)
    vault_folder, project, name = given.vault or options.vault or ".veilframe", given.project or options.project or root, given.engine or options.engine
    if given.command in ("exec", "run") and not command:
        parser.error("a command is expected behind --")
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    paths = [os.path.abspath(p) for p in given.paths]
    if given.command == "mask":
        print("\n".join(mask(spark, paths, vault_folder, project, name, given.dry_run, options)))
    elif given.command == "restore":
        print("\n".join(restore(spark, paths, vault_folder, project)))
    elif given.command in ("exec", "run"):
        return run_command(spark, command, vault_folder, project, root, name, given.command == "exec", given.dry_run, not given.no_restore)
    else:
        vault, _ = _latest(spark, vault_folder, "mappings", vaults.MAPPINGS)
        sessions, _ = _latest(spark, vault_folder, "sessions", vaults.SESSIONS)
        (vaults.list_sessions(sessions, project, 20).select("session_id", "created_at", "status", "input_files") if given.command == "sessions" else vaults.vault_stats(vault, sessions)).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
