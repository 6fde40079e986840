"""The engine's own operators: small cases by hand."""

import json
import unicodedata
from collections import Counter

import pytest

from strataline.functions.textnorm import query_pattern, stripped, text_pieces
from strataline.operators import blocks, catalog, context, index, language, query, sections, timing
from strataline.operators.boundaries import boundaries, is_marker
from strataline.plans import engine, pipeline
from strataline.session import materialize, release, shared_dir, small
from strataline.sources import config as C
from strataline.sources import lines as S

REPORT = [
    "=" * 56, "------ MEMORY INFO (/proc/meminfo) ------", "MemTotal: 1", "an ANR here", "------ 0.001s was the duration of 'MEMORY INFO' ------",
    "------ VIRTUAL MEMORY STATS (/proc/vmstat) ------", "nr_free 1", "------ 0.002s was the duration of 'VIRTUAL MEMORY STATS' ------", "------ ACTIVITY MANAGER ACTIVITIES ------",
    "com.example ANR", "com.example crash", "------ 0.003s was the duration of 'ACTIVITIES' ------",
]


def frame(spark, texts):
    return spark.createDataFrame([(r, i, x) for r, t in texts.items() for i, x in enumerate(t, 1)], "report_id long, line_number long, content string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sections_of_a_small_report(spark):
    lines = frame(spark, {1: REPORT})
    got = rows(sections.detect_sections(lines).select("name", "start_line", "end_line", "level", "section_type"), "start_line")
    assert got == [("HEADER", 1, 1, 1, "equals_separator"), ("MEMORY INFO (/proc/meminfo)", 2, 5, 2, "dash_separator"), ("VIRTUAL MEMORY STATS (/proc/vmstat)", 6, 8, 2, "dash_separator"), ("ACTIVITY MANAGER ACTIVITIES", 9, 0, 2, "dash_separator")]
    tree = rows(sections.section_tree(sections.detect_sections(lines)).select("start_line", "parent_start"), "start_line")
    assert tree == [(1, None), (2, 1), (6, 1), (9, 1)]
    hits = rows(index.keyword_index(lines, ["ANR", "crash"]).select("keyword", "line_number"), "keyword", "line_number")
    assert hits == [("anr", 4), ("anr", 10), ("crash", 11)]
    assert sections.detect_sections(lines.limit(0)).count() == 0


def test_tree_with_jumps(spark):
    df = spark.createDataFrame([(1, s, lv) for s, lv in [(1, 1), (2, 3), (3, 2), (4, 3), (5, 1), (6, 3)]], "report_id long, start_line long, level int")
    assert rows(sections.section_tree(df).select("start_line", "parent_start"), "start_line") == [(1, None), (2, 1), (3, 1), (4, 3), (5, None), (6, 5)]


@pytest.mark.parametrize(
    "line,types",
    [
        ("=" * 20, ["equals_separator"]), (" ------ A B ------\t", ["dash_separator"]), ("------ 0.1s was the duration of 'X' ------", ["dash_separator", "duration_marker_major"]),
        ("--------- 0.1s was the duration of dumpsys x", ["duration_marker_dumpsys"]), ("***x***", ["asterisk_separator"]), ("###x###", ["hash_separator"]), ("----- pid 1 at x", ["trace_start"]),
        ("----- end 12", ["trace_end"]), ("----- end 12 -----", []), ("[  1.5] x", ["kernel_timestamp"]), ("== A ==", ["equals_with_text"]), ("   ", []), ("", []), (None, []),
    ],
)
def test_markers(spark, line, types):
    got = boundaries(frame(spark, {1: [line]})).collect()
    assert (got[0].match_types if got else []) == types and (not got or got[0].content == line)
    assert bool(types) == (bool(line) and is_marker(line.strip()))


def test_lines_of_files(spark, tmp_path):
    for name, text in {"a": b"one\r\ntwo\rthree\n\n\nsix", "b": b"", "c": b"\n\n\n", "d": b"ok\nb\xffad\n", "e": "\n".join(["z" * 10_000, *map(str, range(9999))]).encode()}.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {}
        for r in S.read_text_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file[-1], {})[r.line_number] = r.content
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["a"] == {1: "one", 2: "two", 3: "three", 4: "", 5: "", 6: "six"} and "b" not in got
    assert got["c"] == {1: "", 2: "", 3: ""} and got["d"] == {1: "ok", 2: "bad"}
    assert got["e"] == {1: "z" * 10_000} | {i + 2: str(i) for i in range(9999)}


def test_text_rules(spark):
    df = spark.createDataFrame([("\x1c 　x y \t",)], "c string")
    assert df.select(stripped(df.c)).first()[0] == "\x1c 　x y \t".strip() == "x y"
    df = spark.createDataFrame([("a\r\nb\rc\n",), ("\n\n\n",), ("x y",)], "c string")
    assert [r[0] for r in df.select(text_pieces(df.c)).collect()] == [["a", "b", "c"], ["", "", ""], ["x y"]]
    assert query_pattern("(unclosed") is None and query_pattern("(?P<n>a)(?P=n)$").endswith(r"(?<n>a)\k<n>\z")


def test_ranges_points_offsets(spark):
    lines = frame(spark, {1: ["a", "bé", "", "d"], 2: ["x"]})
    assert S.line_range(lines, 2, 3).count() == 2 and S.line_at(lines, 9).count() == 0 and S.up_to(lines, 1).count() == 2 and S.up_to(lines, None).count() == 5
    want = [(1, 1, 0), (1, 2, 2), (1, 3, 6), (1, 4, 7), (2, 1, 0)]
    assert rows(S.byte_offsets(lines), "report_id", "line_number") == want
    sized = lines.selectExpr("report_id", "line_number", "cast(octet_length(content) + 1 as bigint) n")
    assert rows(S.running_before(sized, "n", size=2).select("report_id", "line_number", "before"), "report_id", "line_number") == want
    assert rows(S.read_until(lines, "^b").select("report_id", "line_number"), "report_id", "line_number") == [(1, 1), (1, 2), (2, 1)]
    assert S.emit(lines, lines.content).count() == 4


def test_subsections_first_pattern_wins(spark):
    lines = frame(spark, {1: ["x", "Foo bar", "foo", "BAR", "y"]})
    p = [{"name": "b", "pattern": "bar"}, {"pattern": "foo", "priority": "HIGH", "category": "c"}]
    assert rows(sections.subsections(lines, p).select("name", "start_line", "end_line", "priority"), "start_line") == [("b", 2, 2, "MEDIUM"), ("foo", 3, 3, "HIGH"), ("b", 4, 0, "MEDIUM")]
    assert rows(sections.subsections(lines, p, 3, 4).select("start_line", "end_line"), "start_line") == [(3, 3), (4, 4)]
    assert sections.subsections(lines, []).count() == 0


def test_queries(spark):
    lines = frame(spark, {1: ["A.b error", "axb", "É timeout", None, "warn"]})
    qs = query.QuerySet()
    for name, kind, pattern in [("lit", "keyword", "a.B"), ("re", "regex", "A.B"), ("uni", "regex", "é"), ("bad", "regex", "("), ("none", "keyword", ""), ("sec", "section", "x"), ("odd", "other", "x")]:
        qs.register(name, kind, pattern)
    qs.queries["off"] = query.Query("off", "keyword", "a", enabled=False)
    with pytest.raises(ValueError):
        qs.register("lit", "keyword", "x")
    with pytest.warns(UserWarning):
        assert rows(query.many(lines, qs).select("query_name", "line_number"), "query_name", "line_number") == [("lit", 1), ("re", 1), ("re", 2), ("uni", 3)]
    found = index.keyword_index(lines, ["Timeout", "gone"])
    router = query.Router(lines, ["timeout"], found.unionByName(frame(spark, {1: ["x"]}).selectExpr("'timeout' keyword", "report_id", "99L line_number")))
    assert router.is_preset("TIMEOUT") and rows(router.query("TimeOut").select("line_number", "keyword"), "line_number") == [(3, "TimeOut")]
    assert router.query("warn").count() == 1
    assert rows(index.keyword_counts(found, ["Timeout", "gone"]), "keyword") == [("gone", 0), ("timeout", 1)]


def test_index_query_looks_both_ways(spark):
    enhanced = spark.createDataFrame([("Slow", 1, 5), ("slow", 1, None), ("x", 1, 1)], "keyword string, report_id long, line_number long")
    custom = spark.createDataFrame([("k", "keyword", "SLOW", 1, [1, None]), ("r", "regex", "s.o", 1, [2]), ("bad", "regex", "(", 1, [3]), ("n", "keyword", None, 1, [4])], "query_name string, type string, pattern string, report_id long, line_numbers array<long>")
    assert sorted((r.source, r.line_number) for r in query.index_query("sLow", enhanced, custom).collect()) == [("custom", 1), ("custom", 2), ("preset", 5)]
    with pytest.raises(ValueError):
        query.index_query("x", enhanced, custom, False, False)


def test_context_and_pages(spark):
    lines = frame(spark, {1: [f"l{i}  " for i in range(1, 6)]})
    hits = spark.createDataFrame([(1, 1), (1, 5), (1, 9)], "report_id long, line_number long")
    assert rows(context.context_lines(lines, hits, 1, 1), "hit_line", "line_number") == [(1, 1, "hit", 1, "l1"), (1, 1, "after", 2, "l2"), (1, 5, "before", 4, "l4"), (1, 5, "hit", 5, "l5")]
    tolerant = context.context_lines(lines, hits, 1, 1, tolerant=True)
    assert rows(tolerant.where("hit_line = 9"), "line_number") == [(1, 9, "hit", 9, "")]
    nested = context.nested_context(tolerant).orderBy("line_number").first()
    assert [x.content for x in nested.context.after] == ["l2"] and nested.context.before == []
    assert context.tokens_per_result() == 275 and context.page_size() == 116 and context.page_size(1, 0, 0) == 1
    for n, sizes in [(115, [115]), (116, [116]), (117, [116, 1])]:
        many = spark.range(n).selectExpr("'q' query_name", "1L report_id", "id line_number")
        assert [r.n for r in context.pages(many, 116).groupBy("part").count().withColumnRenamed("count", "n").orderBy("part").collect()] == sizes


def test_pages_are_written(spark, tmp_path):
    lines = frame(spark, {1: ["a", "b", "a"]})
    hits = index.keyword_index(lines, ["a"]).selectExpr("'q' query_name", "report_id", "line_number")
    nested = context.nested_context(context.context_lines(lines, hits, 1, 1))
    about = spark.createDataFrame([("q", "keyword", "a", "LOW", "")], "query_name string, type string, pattern string, priority string, description string")
    paged, root, out = context.pages(hits, 1), str(tmp_path / "r"), tmp_path / "files"
    results = context.result_rows(paged, about, 1, 1, 1)
    assert context.write_pages(paged, nested, results, root).first().total_parts == 2
    assert context.queries_with_results(spark, root) == ["q"] and context.export_files(spark, root, str(out)) == 4
    part = json.loads((out / "q" / "context" / "part_2.json").read_text())
    assert part["pagination"] == {"total_parts": 2, "current_part": 2, "results_in_part": 1} and part["results"][0]["line_number"] == 3
    assert [x["content"] for x in part["results"][0]["context"]["before"]] == ["b"]
    result = json.loads((out / "q" / "result.json").read_text())
    assert (result["query"], result["type"], result["total_matches"], [x["line_number"] for x in result["line_numbers"]]) == ("q", "keyword", 2, [1, 3])
    assert json.loads((out / "q" / "metadata.json").read_text())["results_per_page"] == 1
    assert context.write_single(paged, nested, results, root).first().total_parts == 1 and context.export_files(spark, root, str(out / "s"), single=True) == 2
    assert [x["line_number"] for x in json.loads((out / "s" / "q" / "result.json").read_text())["results"]] == [1, 3]


def test_pages_share_files(spark, tmp_path):
    hits = spark.range(3_000).selectExpr("if(id % 3 = 0, 'p', 'q') query_name", "1L report_id", "id line_number")
    nested = hits.selectExpr("report_id", "line_number", "'x' content", "struct(array(1L) before, array(2L) after) context")
    about = spark.createDataFrame([], "query_name string, type string, pattern string, priority string, description string")
    paged = context.pages(hits, 5)
    context.write_pages(paged, nested, context.result_rows(paged, about, max_tokens=1400), str(tmp_path))
    assert len(list((tmp_path / "context").rglob("*.json"))) <= 2 and context.read_pages(spark, str(tmp_path), "p").count() == 200
    first = context.read_results(spark, str(tmp_path)).where("query_name = 'p'").first()
    assert [x.line_number for x in first.line_numbers] == list(range(0, 300, 3))


def test_a_cluster_names_its_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)


def test_times(spark):
    lines = frame(spark, {1: ["12-30 10:00:00.571  root  1123  1123 D io", "[  175.5] k", "x ending at: 2025-12-30 10:00:21", "12-30 10:00:23 y", "no", "02-30 10:00:00.000 bad"]})
    got = [(r.time_format, str(r.ts)) for r in timing.timed(lines, 2025).orderBy("line_number").collect()]
    assert got == [("logcat", "2025-12-30 10:00:00.571000"), ("kernel", "1970-01-01 00:02:55.500000"), ("dumpsys", "2025-12-30 10:00:21"), ("system", "2025-12-30 10:00:23")]
    times = timing.timed(lines, 2025)
    assert timing.between(times, "2025-12-30 10:00:21", "2025-12-30 10:00:23").count() == 2
    near = timing.time_context(times, spark.createDataFrame([(1, 4)], "report_id long, line_number long"), 2, 0)
    assert rows(near, "line_number") == [(1, 3), (1, 4)]
    assert timing.line_fields(lines, "logcat_line").first().level == "D"


def test_language(spark):
    q = language.parse('SELECT * FROM section = "a b" WHERE keyword = "k" AND time BETWEEN "10:00" AND "11:00" BEFORE 30s AND AFTER 5s')
    assert (q.section, q.keyword, q.time_range, q.before, q.after) == ("a b", "k", ("10:00", "11:00"), 30, 5)
    assert language.parse("select *").keyword is None
    for bad in ("", "SELECT", 'SELECT * WHERE "x"', 'SELECT * WHERE keyword = "a" BEFORE', "SELECT * LIMIT 3", 'SELECT * WHERE keyword = "open'):
        with pytest.raises(language.LanguageError):
            language.parse(bad)
    lines = frame(spark, {1: ["12-30 10:00:00.571 x", "12-30 10:00:05.000 HIT", "12-30 10:10:00.000 hit"]})
    empty = sections.detect_sections(lines)
    run = lambda t: [r[1] for r in rows(language.run(t, lines, empty, 2025, "2025-12-30"), "line_number")]
    assert run('SELECT * WHERE keyword = "hit"') == [2, 3] and run('SELECT * WHERE keyword = "hit" AND time BETWEEN "10:00" AND "10:01"') == [2]
    assert run('SELECT * WHERE keyword = "hit" AND time BETWEEN "10:00" AND "10:01" BEFORE 5s') == [1, 2] and run('SELECT * FROM section = "x"') == []


def test_blocks(spark):
    lines = frame(spark, {1: ["x", "----- pid 1 at now -----", "a", "----- end 1 -----", "b", "[1.5] k", "c", "\tat a.b(c)", "d"]})
    want = [(1, "anr", 2, 4, "CRITICAL"), (1, "kernel", 6, 6, "MEDIUM"), (1, "stacktrace", 8, 9, "HIGH")]
    assert rows(blocks.record_blocks(lines), "start_line") == want
    with_text = blocks.block_contents(blocks.record_blocks(lines), lines).orderBy("start_line").first()
    assert with_text.content_lines == ["----- pid 1 at now -----", "a", "----- end 1 -----"]
    assert blocks.fine_chunks(blocks.record_blocks(lines), 3).count() == 1
    assert [r.n_lines for r in blocks.chapter_chunks(frame(spark, {1: ["h", "--- System x", "y", "=" * 20]})).orderBy("start_line").collect()] == [1, 2, 1]
    assert rows(blocks.record_chunks(frame(spark, {1: ["aaa", "bbb", "c"]}), 8).select("start_line", "end_line", "n_bytes", "byte_offset"), "start_line") == [(1, 2, 8, 0), (3, 3, 2, 8)]


def test_record_types(spark):
    got = rows(blocks.record_types(frame(spark, {1: REPORT})).select("record_type", "start_line", "end_line"), "start_line", "record_type")
    assert got == [("header", 1, 2), ("memory_info", 2, 5), ("vmstat", 6, 8)]


def test_catalogues():
    of = lambda rows, j: sorted(Counter(r[j] for r in rows).items())
    assert len({r[0] for r in catalog.RECORD_TYPES}) == 36 and of(catalog.RECORD_TYPES, 1) == [("CRITICAL", 6), ("HIGH", 11), ("LOW", 8), ("MEDIUM", 11)]
    assert len({r[0] for r in catalog.SUBSECTIONS}) == 80 and of(catalog.SUBSECTIONS, 2) == [("CRITICAL", 4), ("HIGH", 28), ("LOW", 20), ("MEDIUM", 28)]
    assert len({r[:3] for r in catalog.KNOWLEDGE}) == 24 and len([r for r in catalog.KNOWLEDGE if r[3]]) == 8
    assert len(catalog.preset_keywords()) == 36 and len(catalog.PRESERVED) == 9


def test_every_subsection_is_found_by_its_own_line(spark):
    lines = []
    for _, pattern, _, _ in catalog.SUBSECTIONS:
        service = pattern.startswith("was")
        lines.append(f"--------- 7.123s {pattern}, ending at: 2025-01-01 00:00:00" if service else f"{pattern} (dumpsys activity x)")
        lines.append(pattern.upper() + "x")  # goes on with a word
    found = sections.subsections(frame(spark, {1: lines}), catalog.dump_subsections()).orderBy("start_line").select("name", "start_line", "priority", "category").collect()
    assert [tuple(r) for r in found] == [(n, 2 * i + 1, r, c) for i, (n, _, r, c) in enumerate(catalog.SUBSECTIONS)]


def test_record_types_of_any_beginning_and_of_many_marks(spark):
    lines = frame(spark, {1: ["BEGIN", "x", "END", "BEGIN", "BEGIN"], 2: ["=" * 20] * 20_000})
    own = blocks.record_types(lines.where("report_id = 1"), [("t", "LOW", "c", "^BEGIN", "^END")])
    assert rows(own.select("start_line", "end_line"), "start_line") == [(1, 3), (4, 5), (5, 5)]
    assert blocks.record_types(lines.unionByName(lines)).where("report_id = 2 and end_line = 20000").select("start_line").distinct().count() == 20_000


def test_tree_of_any_levels(spark):
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate((6, 7, 8, 9, 7, None, 8, -1, 500), 1)] + [(2, 1, 9)], "report_id long, start_line long, level int")
    got = rows(sections.section_tree(df).select("report_id", "start_line", "parent_start"), "report_id", "start_line")
    assert got == [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 1), (1, 6, None), (1, 7, 5), (1, 8, None), (1, 9, 8), (2, 1, None)]


def test_integrity(spark):
    r = spark.createDataFrame([(1, 2, 5), (1, 5, 6), (1, 9, 9), (1, 30, 31)], "report_id long, start_line long, end_line long")
    ends = spark.createDataFrame([(1, 33), (2, 2)], "report_id long, report_end long")
    assert rows(blocks.overlaps(r), "start_line") == [(1, 5, 6, 5)]
    assert rows(blocks.gaps(r, ends), "report_id", "gap_start") == [(1, 1, 1), (1, 7, 8), (1, 10, 29), (1, 32, 33), (2, 1, 2)]
    assert rows(blocks.repaired(r), "start_line") == [(1, 2, 5, 1), (1, 5, 9, 2), (1, 30, 31, 1)]
    df = spark.createDataFrame([(1, "a", "0cc175b9c0f1b6a831c399e269772661"), (2, "b", "x"), (3, None, None)], "id long, t string, c string")
    assert rows(blocks.verify(df, "t", "c").select("id"), "id") == [(2,)]


def test_verified_trims_every_space_separator(spark, tmp_path):
    """Blanks beside U+0020 are trimmed as the SQL trims them; other white space stays."""
    zs = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) == "Zs"]
    texts = ["a b", "", None, *[x for b in zs for x in (b, b + "a", "a" + b, b + " a" + b, "a" + b + "a")], *["\t", "\n", "a\r", "\u0085a", "\u180ea", "\u200b", "a\u2028", "\ufeffa", "\ta\u00a0\n", " \t "]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i,) for i, t in enumerate(texts) if t and (t[0] in zs or t[-1] in zs)]
    assert rows(engine.QUERIES["verified"](spark, str(tmp_path)), "doc_id") == want
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(engine.ORACLES["verified"]).fetchall()) == want


def test_tokens_and_composite(spark):
    docs = spark.createDataFrame([(1, "The Cat_1 and a dög, cat_1"), (2, "dög 123"), (3, None)], "id long, t string")
    tokens = index.token_index(docs, "id", "t")
    assert rows(tokens, "id", "token") == [("cat_1", 1), ("dög", 1), ("123", 2), ("dög", 2)]
    assert rows(index.with_all(tokens, ["DÖG", "cat_1"], "id"), "id") == [(1,)] and index.with_all(tokens, [], "id").count() == 0
    assert rows(index.with_any(tokens, ["123", "cat_1"], "id"), "id") == [(1,), (2,)]
    chunks = spark.sql("select 1L id, 'a' record_type, timestamp_ntz'2024-01-01' ts union all select 2L, 'b', timestamp_ntz'2024-01-02'")
    assert query.composite(chunks, tokens, "id").count() == 0
    assert rows(query.composite(chunks, tokens, "id", ["a", "b"], ("2024-01-01", "2024-01-02"), ["dög", "123"]).select("id"), "id") == [(2,)]
    assert query.composite(chunks, tokens, "id", words=["cat_1", "123"], any_word=True).count() == 2


def test_config(tmp_path):
    with pytest.raises(FileNotFoundError):
        C.load_yaml(tmp_path / "none.yaml")
    yaml = pytest.importorskip("yaml")
    (tmp_path / "bad.yaml").write_text("a: [1")
    with pytest.raises(yaml.YAMLError):
        C.load_yaml(tmp_path / "bad.yaml")
    (tmp_path / "c.yaml").write_text("boundary_markers: {a: {pattern: '^x'}, b: {}}\nrecord_types: {r: {keywords: [One], subsections: [{name: s, pattern: p, keywords: [TWO]}]}}\nkeywords: {g: [one, Three]}\n")
    c = C.Config.load(tmp_path / "c.yaml")
    assert c.markers == (("a", "^x"),) and c.metadata == {} and c.interest_points == []
    assert catalog.preset_keywords(c) == ["one", "three", "two"] and c.subsections[0]["parent_record_type"] == "r"
    for text in ('{"queries": []}', '{"queries": [{"name": "a"}, {"name": "a"}]}'):
        (tmp_path / "q.json").write_text(text)
        with pytest.raises(C.ConfigError):
            C.load_queries(tmp_path / "q.json")
    with pytest.raises(C.ConfigError):
        C.load_queries(tmp_path / "absent.json")


def test_materialize_and_small(spark):
    release(spark)
    df = materialize(spark.range(5).selectExpr("id", "array(id) a"), "t")
    assert df.count() == 5 and "parquet" in df.inputFiles()[0]
    assert release(spark) == 1 and release(spark) == 0
    assert "hints" not in str(small(df, 0)._jdf.queryExecution().logical()) and "broadcast" in str(small(df)._jdf.queryExecution().logical()).lower()


def test_knowledge_has_every_group_and_threshold_of_the_survey(spark):
    groups = {}
    for area, focus, patterns, _, _ in catalog.KNOWLEDGE:
        groups.setdefault(area, {})[focus] = len(patterns)
    assert {a: sorted(g.values()) for a, g in groups.items()} == {
        "system_services": [4, 4, 5], "kernel": [4, 4, 4], "native_services": [3, 4], "binder": [3, 4], "performance": [3, 3, 3, 4],
        "background_control": [4, 4, 4], "animation_jank": [3, 3, 3, 3], "power_consumption": [3, 3, 4],
    }
    assert {n: v for *_, n, v in catalog.KNOWLEDGE if n} == {"cold_start": 5000, "warm_start": 2000, "hot_start": 500, "jank_count": 5, "serious_jank": 100, "slow_binder": 50, "very_slow": 200, "lock_wait": 100}
    lines = frame(spark, {1: ["pm_runtime", "Displayed com.x/.Main: +2600ms", "waiting to lock <0x1> 120 ms", "waiting to lock <0x1>", "binder call duration 250 ms", "Radio active"]})
    got = rows(query.tagged(lines, catalog.KNOWLEDGE).select("line_number", "domain", "focus", "threshold_name", "value"), "line_number", "threshold_name")
    p = "performance"
    assert got == [
        (1, "kernel", "power", None, None), (2, p, "launch", None, None), (2, p, "launch", "hot_start", 2600.0), (2, p, "launch", "warm_start", 2600.0), (3, p, "locks", None, None),
        (3, p, "locks", "lock_wait", 120.0), (4, p, "locks", None, None), (5, p, "binder", "slow_binder", 250.0), (5, p, "binder", "very_slow", 250.0), (6, "power_consumption", "battery", None, None),
    ]


def test_record_types_end_at_lines_that_are_no_markers(spark):
    lines = frame(spark, {1: ["***Battery log***", "level 5", "", "more", "------ SYSTEM LOG", "Begin x", "Done", "last"]})
    got = rows(blocks.record_types(lines).select("record_type", "start_line", "end_line"), "record_type")
    assert ("battery_log", 1, 3) in got
    mine = blocks.record_types(lines, [("mine", "LOW", "own", "^Begin", "^Done")])
    assert rows(mine.select("record_type", "start_line", "end_line"), "start_line") == [("mine", 6, 7)]


def test_index_query_searches_every_pattern(spark):
    custom = spark.createDataFrame([("q", "regex", p, 1, [n, None]) for n, p in enumerate(["slow", "s.ow", "fast", "(", "l", None])] + [("k", "keyword", "SLOW", 1, [9])], "query_name string, type string, pattern string, report_id long, line_numbers array<long>")
    enhanced = spark.createDataFrame([("slow", 1, 7)], "keyword string, report_id long, line_number long")
    hits = query.index_query("slow", enhanced, custom)
    assert [r[0] for r in rows(hits.select("line_number"), "line_number")] == [0, 1, 4, 7, 9]
    assert rows(query.index_answer(hits), "report_id") == [(1, ["custom_index", "enhanced_index"], 5)]
    assert rows(query.index_answer(query.index_query("slow", enhanced, custom, use_custom=False)), "report_id") == [(1, ["enhanced_index"], 1)]
    many = spark.range(12_000).selectExpr("concat('q', id) query_name", "'regex' type", "concat('slow|', id) pattern", "1L report_id", "array(id) line_numbers")
    assert query.index_query("slow", enhanced, many, use_preset=False).count() == 12_000


def test_any_number_of_queries(spark):
    lines = frame(spark, {1: ["alpha Beta", "gamma 7", "x"], 2: ["------ ALPHA ------", "beta"]})
    toc = spark.createDataFrame([(1, "Alpha part", 1, 2), (2, "rest", 1, 0)], "report_id long, name string, start_line long, end_line long")
    qs = query.QuerySet()
    for i in range(5):
        qs.register(f"k{i}", "keyword", ("BETA", "amma", "nothing", "x", "")[i])
    qs.register("r", "regex", r"A\w+ |\d$")
    qs.register("broken", "regex", "(")
    qs.register("s", "section", "alpha")
    qs.register("t", "section", "r")
    few = rows(query.many(lines, qs, toc), "query_name", "report_id", "line_number")
    assert ("s", 1, 2) in few and ("t", 2, 2) in few and ("r", 1, 2) in few and ("k0", 2, 2) in few
    for i in range(400):
        qs.register(f"absent{i}", "keyword", f"absent {i}")
        qs.register(f"no section{i}", "section", f"absent {i}")
    for block in (7, 20_000):
        assert rows(query.many(lines, qs, toc, block), "query_name", "report_id", "line_number") == few


def test_twenty_thousand_queries(spark):
    table = spark.range(20_000).selectExpr("concat('q', id) name", "if(id % 2 = 0, 'keyword', 'section') type", "concat('w', id, '.') pattern", "'LOW' priority", "cast(null as string) description", "true enabled")
    lines = frame(spark, {1: ["a w40. b", "w19999. w2."]})
    toc = spark.createDataFrame([(1, "w7. w19999.", 2, 0)], "report_id long, name string, start_line long, end_line long")
    got = rows(query.many(lines, query.QuerySet.from_table(table), toc), "query_name", "line_number")
    assert [(r[0], r[2]) for r in got] == [("q19999", 2), ("q2", 2), ("q40", 1), ("q7", 2)]


def test_pipeline_stops_at_the_first_failure():
    said = []
    stages = [pipeline.Stage("a", lambda m: 1), pipeline.Stage("b", lambda m: m["a"] + 1, lambda made: made < 2), pipeline.Stage("c", lambda m: said.append(1))]
    out = pipeline.run(stages)
    assert [s[:2] for s in out.stages] == [("a", "ok"), ("b", "failed"), ("c", "skipped")] and not out.ok and not said and out.made["b"] == 2
    assert pipeline.run([pipeline.Stage("x", lambda m: 1 / 0)]).error.startswith("x: ZeroDivisionError")
    assert pipeline.run(stages[:1], {"z": 0}).ok


def test_whole_file_subsections(spark):
    lines = frame(spark, {1: ["a x", "b", "A y", "c"]})
    ends = lambda n: [r[0] for r in rows(sections.whole_file_subsections(lines, [{"name": "a", "pattern": "a "}], n).select("end_line"), "end_line")]
    assert ends(None) == [2, 4] and ends(10_000_000) == [2, 10_000_000]
