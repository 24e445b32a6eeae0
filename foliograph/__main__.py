"""Command line: ``python -m foliograph STORE COMMAND ...`` over a versioned wiki store."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliograph.operators import dedup, lint, retrieval
from foliograph.operators.files import file_status
from foliograph.operators.index import raw_file_index
from foliograph.operators.segments import SegmentIndex
from foliograph.operators.segments import search as search_index
from foliograph.functions.text import human_size
from foliograph.plans import browse, ingest, question
from foliograph.session import configure
from foliograph.sources import raw
from foliograph.sources.store import WikiStore
from foliograph.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliograph")
    p.add_argument("store", help="folder of the wiki store")
    commands = p.add_subparsers(dest="command", required=True)
    add = lambda name, text: commands.add_parser(name, help=text)
    c = add("ingest", "ingest raw files")
    c.add_argument("raw")
    c.add_argument("files", nargs="*", help="only these files")
    c.add_argument("--list", action="store_true", help="show files and their status")
    c.add_argument("--reprocess", action="store_true", help="also files that did not change")
    c.add_argument("--use-embeddings", action="store_true")
    c = add("watch", "ingest files as they arrive")
    c.add_argument("raw")
    c.add_argument("--lint", action="store_true")
    c = add("search", "ranked pages")
    c.add_argument("text")
    c.add_argument("--top", type=int, default=10)
    c = add("ask", "answer a question from the wiki")
    c.add_argument("text")
    c.add_argument("--save", action="store_true", help="keep the answer as a page")
    add("lint", "health check")
    add("stats", "page and link counts")
    c = add("dedup", "plan duplicate merges")
    c.add_argument("--apply", action="store_true")
    c.add_argument("--no-registry", action="store_true")
    c = add("reset", "start over with an empty wiki")
    c.add_argument("--confirm", default="")
    return p


def print_rows(df) -> None:
    """All rows as tab-separated text, fetched partition by partition."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def synced(spark: SparkSession, store: WikiStore) -> SegmentIndex:
    """The store's index, brought up to date if the store has a newer version than it was synced with."""
    index = SegmentIndex(spark, f"{store.path}/index")
    index.sync(store.read().pages, store.current())
    return index


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    configure(spark)
    store = WikiStore(spark, args.store)
    wiki = store.read()
    day = datetime.date.today().isoformat()
    if args.command == "ingest":
        files = raw.read_raw(spark, args.raw)
        if args.list:
            status = file_status(files.drop("content"), raw_file_index(wiki.pages))
            print_rows(status.select("filename", human_size(F.col("size_bytes")).alias("size"), "status").orderBy("filename"))
            return
        store.write(ingest.ingest(wiki, files, day, overwrite=args.reprocess, names=args.files or None, use_embeddings=args.use_embeddings, on_failed=print_rows))
        store.read().log.groupBy("day").agg(F.count("*").alias("files")).orderBy("day").show()
    elif args.command == "watch":
        def report(findings):
            lint.summary(findings).orderBy("level", "code").show()

        watch(spark, args.raw, store, f"{args.store.rstrip('/')}/watch-checkpoint", day, on_lint=report if args.lint else None, on_failed=print_rows).awaitTermination()
    elif args.command == "search":
        asked = spark.createDataFrame([(1, args.text)], "query_id int, text string")
        found = search_index(asked, synced(spark, store), args.top)
        print_rows(retrieval.results(found, wiki.pages).orderBy("rank").select("rank", "name", "subdir", "score", "snippet"))
    elif args.command == "ask":
        asked = spark.createDataFrame([(1, args.text)], "query_id int, text string")
        answers = question.answer(asked, wiki.pages, index=synced(spark, store))
        answers.select("route", "label", "answer", "sources").show(1, False)
        if args.save:
            pages = ingest.replace_pages(wiki.pages, question.saved(answers, day))
            store.write(wiki.with_tables(pages=pages))
    elif args.command == "lint":
        findings = lint.report(wiki.pages, wiki.catalog)
        lint.summary(findings).orderBy("level", "code").show()
        print_rows(findings.orderBy("level", "code", "page", "target"))
    elif args.command == "stats":
        lint.page_counts(wiki.pages).show()
        browse.wiki_stats(wiki.pages).show()
    elif args.command == "dedup":
        planned = dedup.plan(wiki.pages, None if args.no_registry else wiki.entries)
        print_rows(planned.orderBy("group_key", "role", "subdir", "name"))
        dedup.plan_totals(planned).show()
        if args.apply:
            store.write(wiki.with_tables(pages=dedup.apply(wiki.pages, planned)))
    elif args.command == "reset":
        if args.confirm != "RESET":
            raise SystemExit("nothing changed: repeat with --confirm RESET")
        store.reset()


if __name__ == "__main__":
    run(SparkSession.builder.appName("foliograph").getOrCreate(), parser().parse_args())
