"""Compiled frames through a source map: mapped, library, stale, unmapped."""

import json

from symtrail.operators import frames as FR
from symtrail.sources import tree


def test_source_map_tier(spark, tmp_path):
    chunks = tmp_path / ".next" / "server" / "chunks"
    chunks.mkdir(parents=True)
    # Generated line 1: column 0 -> users line 3, column 10 -> library line 1, column 20 -> nothing,
    # column 30 -> orders (stale) line 1.  Line 2: column 0 -> users line 4.
    (chunks / "1.js.map").write_text(json.dumps({
        "version": 3, "sources": ["webpack://_N_E/./app/users.ts?x", "webpack://_N_E/./node_modules/lib/a.js", "webpack://_N_E/./app/orders.ts"],
        "sourcesContent": ["one\r\ntwo", None, "old"], "mappings": "AAEA,UCFA,U,UCAA;AFGA"}))
    files = spark.createDataFrame([("r", "app/users.ts", bytearray(b"one\ntwo")), ("r", "app/orders.ts", bytearray(b"new"))],
                                  "repo_id string, rel_path string, content binary")
    maps = tree.source_maps(spark, str(tmp_path), "r", files).cache()
    assert [r.stale for r in maps.collect()] == [[2]]
    positions = FR.map_positions(FR.map_segments(maps))
    got = sorted((r.gen_line, r.gen_column, r.source, r.line) for r in positions.filter("source is not null").collect())
    assert got == [(0, 0, 0, 3), (0, 10, 1, 1), (0, 30, 2, 1), (1, 0, 0, 4)]

    symbols = spark.createDataFrame([("r", "u", "app.users.GET", "GET", "function", "app/users.ts", 3, 5), ("r", "o", "app.orders.GET", "GET", "function", "app/orders.ts", 1, 5),
                                     ("r", "n", "app.orders.only", "only", "function", "app/orders.ts", 7, 8)],
                                    "repo_id string, uid string, qualified_name string, name string, kind string, rel_path string, start_line int, end_line int")
    at = "/app/.next/server/chunks/1.js"
    rows = [("q", 0, at, 1, 5, "t"), ("q", 1, at, 1, 15, "GET"), ("q", 2, at, 1, 25, "GET"), ("q", 3, at, 1, 35, "only"), ("q", 4, at, 2, 1, "t"), ("q", 5, "/x/app/users.ts", 4, 1, "t")]
    frames = spark.createDataFrame([("r", *r) for r in rows], "repo_id string, question_id string, frame_no int, file_path string, line_no int, col_no int, fn_name string")
    out = {r.frame_no: (r.tier, r.uid) for r in FR.resolve(frames, symbols, files.select("repo_id", "rel_path"), str(tmp_path), maps, positions).collect()}
    assert out == {0: ("sourcemap", "u"), 1: ("unresolved", None),      # library: an answer, no name match
                   2: ("unresolved", None), 3: ("name", "n"), 4: ("sourcemap", "u"), 5: ("direct", "u")}
