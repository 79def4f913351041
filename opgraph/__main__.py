"""Command line: ``python -m opgraph <command>``."""

from __future__ import annotations

import argparse
import json

from opgraph.session import get_or_create, table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="opgraph")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("schema", "labels, counts and vocabularies"), ("retrieve", "hybrid retrieval"), ("query", "a read-only SQL or pattern query"), ("sections", "typed sections of span files"), ("ingest", "merge span files into the tables below --out"), ("datasheet", "records of the data sheets of span files"), ("eval", "retrieval scores of a question file"), ("chunk", "chunks of the sections table"), ("run", "a registered query")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--data", required=True, help="directory of the tables")
        p.add_argument("--out", help="write the result here as Parquet")
        if name == "retrieve":
            p.add_argument("question")
            p.add_argument("--projects", default="")
            p.add_argument("--countries", default="")
            p.add_argument("--types", default="")
            p.add_argument("--scope")
            p.add_argument("--k", type=int)
            p.add_argument("--per-project-k", type=int)
            p.add_argument("--front-matter", action="store_true")
            p.add_argument("--no-vector", action="store_true", help="full text only: the table's vectors are not of the default embedder")
        if name in ("ingest", "datasheet", "sections"):
            p.add_argument("--tables", help="detected tables of the same documents, as lines")
            p.add_argument("--aliases", help="alias file")
            p.add_argument("--countries", help="country file")
        if name == "eval":
            p.add_argument("--questions", required=True)
            p.add_argument("--k", type=int, default=8)
            p.add_argument("--jobs", type=int, default=3)
        if name in ("query", "run"):
            p.add_argument("text")
    a = parser.parse_args(argv)
    spark = get_or_create()
    from opgraph import catalog
    from opgraph.operators import chunking, evaluate, graph, pipeline, query, retrieve
    from opgraph.sources.readers import load_aliases, load_countries, read_questions, read_spans, read_tables
    from opgraph.sources.sinks import write_records

    split = lambda s: [x.strip() for x in s.split(",") if x.strip()] or None
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=1, default=str))
    if a.command in ("sections", "datasheet"):
        found = pipeline.extract(read_spans(spark, a.data), read_tables(spark, a.tables) if a.tables else None)
        out = found["sections"] if a.command == "sections" else pipeline.records(found, load_aliases(a.aliases) if a.aliases else None, load_countries(spark, a.countries) if a.countries else None)
        if a.command == "datasheet" and a.out:
            write_records(out, a.out)
            return 0
    elif a.command == "ingest":
        if not a.out:
            parser.error("ingest needs --out")
        show(pipeline.ingest(spark, a.data, a.out, a.tables, load_aliases(a.aliases) if a.aliases else None, load_countries(spark, a.countries) if a.countries else None))
        return 0
    elif a.command == "eval":
        context = retrieve.chunk_context(*(table(spark, a.data, t) for t in ("chunks", "sections", "operations")))
        print(evaluate.retrieval_page(read_questions(spark, a.questions), context, a.k, a.jobs))
        return 0
    elif a.command == "run":
        out = catalog.queries()[a.text](spark, a.data)
    elif a.command == "chunk":
        out = chunking.text_windows(graph.sections(table(spark, a.data, "sections")), "section_id")
    else:
        ops, secs, chunks = (table(spark, a.data, t) for t in ("operations", "sections", "chunks"))
        if a.command == "schema":
            show(graph.graph_schema({"Operation": ops, "Section": secs, "Chunk": chunks}, graph.operations(ops), graph.sections(secs), chunks))
        elif a.command == "query":
            catalog.register_views(spark, a.data)
            show(query.graph_query(spark, a.text))
        else:
            context = retrieve.chunk_context(chunks, secs, ops)
            show(retrieve.retrieve(context, a.question, None, split(a.projects), split(a.countries), split(a.types), a.scope, a.k, a.per_project_k, a.front_matter, embed=not a.no_vector))
        return 0
    if a.out:
        out.write.parquet(a.out)
    else:
        out.show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
