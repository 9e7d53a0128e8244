"""Command line: inspect, sanitize, risk, review, verify, batch, restore, serve, benchmark.

Exit codes: 0 done, 1 a document failed, 2 a leak was blocked, 3 what was written didn't verify, 64 wrong use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import leakscan, metrics, policy, restore, risk, sanitize, synth, tokens, vault
from spanloom.server import serve
from spanloom.sources import readers, writers

TOP = 20


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Files in the order of their paths; the path names a document, so equal file names in two folders stay apart."""
    known = os.path.isdir(path) or os.path.splitext(path)[1].lower().lstrip(".") in (*readers.TEXT, *readers.DOCUMENTS, *readers.IMAGES)
    rows = readers.read_documents(spark, path) if known else readers.read_text(spark, path).withColumn("error", F.lit(None).cast("string"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text", "error")


def _policy(args) -> policy.Policy:
    return policy.load_policy(args.policy) if args.policy.endswith(".json") else policy.get_policy(args.policy)


def inspect(spark, args) -> int:
    made = sanitize.sanitize(_documents(spark, args.path), _policy(args))
    if args.json:
        for row in writers.json_report(made).toLocalIterator():
            print(row["report"])
    else:
        for row in sanitize.entity_report(made).orderBy("doc_id", "entity_type", "idx").toLocalIterator():
            print(row["replacement"], row["entity_type"], row["occurrences"], row["confidence"])
    return 0


def assess(spark, args) -> int:
    made = sanitize.sanitize(_documents(spark, args.path), _policy(args), run_leak_scan=False)
    for row in risk.assess(made, "sanitized").toLocalIterator():
        print(row["level"], row["summary"])
    return 0


def batch(spark, args) -> int:
    """Sanitize every file below a folder; texts, status and vault are three tables, with --files also a file each."""
    chosen = _policy(args)
    docs = _documents(spark, args.path).persist()
    shared = tokens.registry if args.shared_vault else None
    made = sanitize.sanitize(docs, chosen, shared_tokens=shared).persist()
    state = F.when(F.col("error").isNotNull(), "FAIL").when(F.col("leak.blocked"), "BLOCK").otherwise("ok")
    status = docs.select("doc_id", "path", "error").join(made.select("doc_id", "leak"), "doc_id", "left").select("doc_id", "path", state.alias("status"), F.col("leak.summary").alias("leaks"), "error").persist()
    keep = made.where(F.lit(args.force) | F.col("leak.clean"))
    held = sanitize.vault_of(keep)
    try:
        vault.save(held, f"{args.out}/vault", args.passphrase, allow_plaintext=args.allow_plaintext)
        status.write.mode("overwrite").parquet(f"{args.out}/status")
        try:
            writers.write_documents(keep, f"{args.out}/texts", vault=held, verify=not args.force, recognizers=chosen.recognizers)
        except writers.VerificationError as wrong:
            print(wrong, file=sys.stderr)
            return 3
        bad = status.where("status != 'ok'").orderBy("path").limit(TOP).collect()
        for row in bad:
            print(row["status"], row["path"], row["leaks"] or row["error"])
        failed = _files(keep.join(docs.select("doc_id", "path"), "doc_id"), args, chosen) if args.files else 0
    finally:
        for table in (status, made, docs):
            table.unpersist()
    if failed:
        return 3
    return (2 if all(r["status"] == "BLOCK" for r in bad) else 1) if bad else 0


def _files(rows: DataFrame, args, chosen: policy.Policy) -> int:
    """Each document as a file, named by its place below the folder; gives how many were held back. Files are made and read back
    by the tasks; only their bytes come here, one at a time."""
    os.makedirs(f"{args.out}/files", exist_ok=True)
    root, failed = os.path.abspath(args.path), 0
    paths = {r["doc_id"]: r["path"] for r in rows.select("doc_id", "path").toLocalIterator()}
    for row in writers.rendered(rows.withColumn("ext", readers.extension(F.col("path"))), chosen.recognizers).toLocalIterator():
        name = os.path.relpath(paths[row["doc_id"]].removeprefix("file:"), root).replace(os.sep, "__")
        if row["content"] is None or (row["leaks"] and not args.force):
            failed += 1
            print("BLOCK", name, row["error"] or row["leaks"])
            continue
        with open(f"{args.out}/files/{name}", "wb") as file:
            file.write(row["content"])
    return failed


def one(spark, args) -> int:
    """Sanitize one file; what is written is read back first, and the vault goes to a file of its own."""
    if not args.passphrase and not args.allow_plaintext:
        raise ValueError("a vault without a passphrase is written only with --allow-plaintext")
    docs, chosen = _documents(spark, args.path), _policy(args)
    rows = sanitize.sanitize(docs, chosen).head(2)
    if len(rows) != 1:
        raise ValueError(f"{args.path} is {'no file that can be read' if not rows else 'several files; use batch'}")
    row, = rows
    if row["leak"]["blocked"] and not args.force:
        print(f"blocked: {row['leak']['summary']}", file=sys.stderr)
        return 2
    entries = [v.asDict() for v in row["vault"]]
    try:
        writers.write_file(args.out, row["sanitized"] or "", [v["value"] for v in entries], chosen.recognizers, verify=not args.force)
    except writers.VerificationError as wrong:
        print(f"what would be written still leaks: {wrong}", file=sys.stderr)
        return 3
    with open(args.vault, "w", encoding="utf-8") as file:
        file.write(vault.envelope({"session_id": vault.session_id(), "entries": entries}, args.passphrase, spark))
    print(f"{len(row['entities'])} entities, {len(entries)} tokens")
    return 0


def page(spark, args) -> int:
    """A page to look through what would be replaced."""
    made = sanitize.sanitize(_documents(spark, args.path), _policy(args)).first()
    left = risk.assess(spark.createDataFrame([(0, made["sanitized"])], "doc_id long, text string")).first()
    with open(args.out, "w", encoding="utf-8") as file:
        file.write(writers.review_page(made["text"] or "", [e.asDict() for e in made["edits"]], made["leak"]["summary"], left["summary"], os.path.basename(args.path)))
    return 0


def daemon(spark, args) -> int:
    """The HTTP face, until it is interrupted."""
    policies = policy.Registry()
    for path in args.policy_file or ():
        policies.register(policy.load_policy(path))
    server = serve(spark, args.host, args.port, policies)
    print(f"http://{args.host}:{server.server_address[1]}", flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()
    return 0


def benchmark(spark, args) -> int:
    """Synthetic labelled documents through the chain: secrets removed, exact round trips, blocked texts."""
    docs = synth.labelled(spark, args.documents, args.seed)
    chosen = _policy(args)
    secret = F.filter("gold", lambda g: chosen.action(g["entity_type"]) != policy.KEEP)
    fixtures = docs.select("doc_id", "text", F.transform(secret, lambda g: g["value"]).alias("must_remove"))
    made = sanitize.sanitize(docs.select("doc_id", "text"), chosen).persist()
    back = restore.restore(made.select("doc_id", F.col("sanitized").alias("response")), sanitize.vault_of(made))
    row = metrics.fixture_benchmark(made, fixtures, back).first()
    made.unpersist()
    print(json.dumps(row.asDict()))
    return 0 if row["n_removed"] == row["n_secrets"] else 1


def check(spark, args) -> int:
    """What can still be found in a text, by type, and known values of a vault; the risk that is left besides."""
    docs = _documents(spark, args.path)
    left = leakscan.verify(docs).groupBy("entity_type").agg(F.sum("n").alias("n")).orderBy("entity_type").collect()
    for row in left:
        print(row["entity_type"], row["n"])
    leaked = []
    if args.vault:
        known = [r["value"] for r in _vault_rows(spark, args.vault, args.passphrase).select("value").distinct().toLocalIterator() if len(r["value"]) >= leakscan.LEAST_VALUE]
        leaked = sorted({v for r in docs.select("text").toLocalIterator() for v in leakscan.present(r["text"] or "", known)})
        for value in leaked[:TOP]:
            print("known value", repr(value))
    for row in risk.assess(docs).where("level != 'none'").toLocalIterator():
        print("risk", row["level"], row["summary"])
    return 2 if left or leaked else 0


def _vault_rows(spark, path: str, passphrase: str | None) -> DataFrame:
    """Rows of a vault table, or of the sealed file that `sanitize` writes."""
    if os.path.isdir(path):
        return vault.load(spark, path, passphrase)
    with open(path, encoding="utf-8") as file:
        entries = vault.opened(file.read(), passphrase, spark)["entries"]
    return spark.createDataFrame([(0, e["token"], e["entity_type"], e["value"], e["action"], []) for e in entries], vault.ROW_SQL)


def give_back(spark, args) -> int:
    replies = _documents(spark, args.path).select("doc_id", F.col("text").alias("response"))
    rows = _vault_rows(spark, args.vault, args.passphrase)
    if args.one_vault or not os.path.isdir(args.vault):
        # Tokens that stand for different values in different documents are restored in none: see restore.
        replies, rows = replies.withColumn("doc_id", F.lit(0).cast("long")), rows.withColumn("doc_id", F.lit(0).cast("long"))
    texts = []
    for row in restore.restore(replies, rows).toLocalIterator():
        texts.append(row["text"] or "")
        if row["invented"] or row["dropped"]:
            print(json.dumps({"invented": row["invented"], "dropped": row["dropped"]}), file=sys.stderr)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as file:
            file.write("\n".join(texts))
    else:
        print("\n".join(texts))
    return 0


COMMANDS = {"inspect": inspect, "sanitize": one, "risk": assess, "review": page, "verify": check, "batch": batch, "restore": give_back, "serve": daemon, "benchmark": benchmark}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in COMMANDS.items():
        sub = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        sub.set_defaults(run=run)
        if name not in ("serve", "benchmark"):
            sub.add_argument("path")
        if name != "serve":
            sub.add_argument("--policy", default="personal", help="a built-in policy, or the path of a policy file")
        sub.add_argument("--passphrase")
        sub.add_argument("--json", action="store_true")
        if name == "batch":
            sub.add_argument("out")
            sub.add_argument("--shared-vault", action="store_true")
            sub.add_argument("--files", action="store_true", help="also each document as a file in the format of its source")
        if name in ("sanitize", "review"):
            sub.add_argument("--out", required=True)
        if name == "sanitize":
            sub.add_argument("--vault", required=True)
        if name in ("batch", "sanitize"):
            sub.add_argument("--allow-plaintext", action="store_true")
            sub.add_argument("--force", action="store_true")
        if name == "verify":
            sub.add_argument("--vault")
        if name == "restore":
            sub.add_argument("vault")
            sub.add_argument("--one-vault", action="store_true")
            sub.add_argument("--out")
        if name == "serve":
            sub.add_argument("--host", default="127.0.0.1")
            sub.add_argument("--port", type=int, default=8765)
            sub.add_argument("--policy-file", action="append")
        if name == "benchmark":
            sub.add_argument("--documents", type=int, default=30)
            sub.add_argument("--seed", type=int, default=7)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    try:
        return args.run(spark, args)
    except (ValueError, OSError, RuntimeError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 64


if __name__ == "__main__":
    sys.exit(main())
