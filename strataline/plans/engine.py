"""Named queries of the engine's own operators, each with the SQL DuckDB answers it by.

All run over whole tables.  Where a query takes a keyword, range or size, that is the
operator's argument.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.textnorm import blanks_trimmed
from strataline.operators import blocks, catalog, context, index, language, query, sections, timing
from strataline.operators.boundaries import MARKERS, boundaries
from strataline.plans import expected
from strataline.session import shared_dir, table
from strataline.sources import lines as L
from strataline.sources.config import Config, load_indexes, save_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LINES = "lines as (select report_id, line_number, max(content) as content from query_results where content is not null group by all)"
_STRIPPED = r"regexp_replace(content, '^[\s\p{Z}\x{1c}-\x{1f}\x{85}\x0b]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}\x0b]+$', '', 'g')"


def named(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _lines(spark, d) -> DataFrame:
    return L.report_lines(table(spark, d, "query_results"))


def _rows(spark, d) -> DataFrame:
    """Lines with their repeats, for what shuffles less than their text."""
    return L.line_rows(table(spark, d, "query_results"))


def _places(spark, d) -> DataFrame:
    return L.places(table(spark, d, "query_results"))


# ------------------------------------------------------------------ lines
@named(f"with {_LINES} select * from lines")
def report_lines(spark, d):
    return _lines(spark, d)


@named(f"with {_LINES} select * from lines where line_number between 20 and 60")
def line_range(spark, d):
    return L.line_range(_lines(spark, d), 20, 60)


@named(f"with {_LINES} select * from lines where line_number = 7")
def line_point(spark, d):
    return L.line_at(_lines(spark, d), 7)


@named(f"with {_LINES} select report_id, count(*) n_lines from lines group by 1")
def line_count(spark, d):
    return L.line_counts(_places(spark, d))


@named(f"""with {_LINES} select report_id, line_number, cast(coalesce(sum(octet_length(encode(content)) + 1)
    over (partition by report_id order by line_number rows between unbounded preceding and 1 preceding), 0) as bigint) byte_offset from lines""")
def byte_offsets(spark, d):
    return L.byte_offsets(_rows(spark, d), unique=False)


@named(f"""with {_LINES}, stop as (select report_id, min(line_number) s from lines where regexp_matches(content, 'was the duration of') group by 1)
    select l.* from lines l left join stop using (report_id) where s is null or line_number <= s""")
def read_until(spark, d):
    return L.read_until(_lines(spark, d), "was the duration of")


_DOC_LINES = r"""doc_lines as (select doc_id, cast(generate_subscripts(p, 1) as bigint) line_number, unnest(p) as content from
    (select doc_id, case when p[-1] = '' then p[:-2] else p end p from (select doc_id, regexp_split_to_array(text, '\r\n|\r|\n') p from documents where text <> '')))"""


@named(f"with {_DOC_LINES} select * from doc_lines")
def doc_lines(spark, d):
    return L.lines_of(table(spark, d, "documents"), "doc_id", "text")


# ------------------------------------------------------------------ boundaries and sections
def _re2(p: str) -> str:
    return (p if p.startswith("^") else "^(?:" + p + ")").replace("'", "''")


_TYPES = "list_filter([" + ", ".join(f"case when regexp_matches(t, '{_re2(p)}') then '{n}' end" for n, p in MARKERS) + "], lambda x: x is not null)"
_MARKED = f"marked as (select report_id, line_number, content, t, {_TYPES} m from (select *, {_STRIPPED} t from lines) where t <> '')"


@named(f"with {_LINES}, {_MARKED} select report_id, line_number, content, array_to_string(m, ',') match_types from marked where len(m) > 0")
def boundary_lines(spark, d):
    return boundaries(_lines(spark, d)).withColumn("match_types", F.array_join("match_types", ","))


_SECTIONS = rf"""{_LINES}, {_MARKED}, named as (
    select report_id, line_number start_line, m[1] section_type,
      case when list_contains(m, 'equals_separator') then 'HEADER'
           when list_contains(m, 'dash_separator') then coalesce(nullif(regexp_extract(t, '^-+\s+(.+?)\s+-+$', 1), ''), nullif(regexp_extract(t, '^-+\s+(.+?)(?:\s*\(.*\))?$', 1), ''))
           when list_contains(m, 'equals_with_text') then nullif(regexp_extract(t, '^=+\s+(.+?)\s+=+$', 1), '') end as name,
      case when len(list_filter(m, lambda x: x like 'equals%')) > 0 then 1 when list_contains(m, 'dash_separator') then 2 else 1 end as level
    from marked where len(m) > 0 and len(list_filter(m, lambda x: x like '%duration_marker%')) = 0),
  secs as (select report_id, name, start_line, coalesce(lead(start_line) over (partition by report_id order by start_line) - 1, 0) end_line,
      section_type, level, 'MEDIUM' priority, 'unknown' category from named where name is not null)"""


def _sections(spark, d) -> DataFrame:
    return sections.detect_sections(_lines(spark, d))


@named(f"with {_SECTIONS} select * from secs")
def detected_sections(spark, d):
    return _sections(spark, d)


@named(f"with {_SECTIONS} select level, count(*) n_sections from secs group by 1")
def section_counts(spark, d):
    return sections.level_counts(_sections(spark, d))


# Subsections of the test reports' own dumps, which go after the catalogue's.
_OWN = (("mixer", "dumpsys AUDIOMIX", "HIGH", "audio"), ("window", "service windowloom", "HIGH", "window"), ("window end", "dumpsys windowloom", "LOW", "window"), ("clients", " clients-", "MEDIUM", "any"), ("a dump", "was the duration of dumpsys", "LOW", "any"))
_SERVICES = catalog.dump_subsections() + [{"name": n, "pattern": p, "priority": r, "category": c} for n, p, r, c in _OWN]
_CATALOGUE = f"""cat(i, name, pattern, priority, category) as (values {expected.SUBSECTIONS}, """ + ", ".join(f"({i}, '{n}', '{p}', '{r}', '{c}')" for i, (n, p, r, c) in enumerate(_OWN, 81)) + ")"
_HOLDS = r"""(contains(lower(content), lower(pattern)) and (i > 80 or regexp_matches(lower(content), '\Q' || lower(pattern) || '\E(?:$|[^\w\s]|\s+$|\s+[^\w\s])')))"""
_SUBS = f"""{_CATALOGUE}, held as (select report_id, line_number, arg_min(cat, i) c from lines, cat where {_HOLDS} group by 1, 2),
  subs as (select report_id, c.name as name, line_number start_line, coalesce(lead(line_number) over (partition by report_id order by line_number) - 1, 0) end_line,
    'subsection' section_type, 3 as level, c.priority as priority, c.category as category from held)"""


def _subsections(spark, d) -> DataFrame:
    return sections.subsections(_lines(spark, d), _SERVICES)


@named(f"with {_LINES}, {_SUBS} select * from subs")
def subsections(spark, d):
    return _subsections(spark, d)


@named(f"""with {_SECTIONS}, ends as (select report_id, max(line_number) report_end from lines group by 1),
  parents as (select report_id, name parent_section, start_line parent_start, case when end_line = 0 then report_end else end_line end e from secs join ends using (report_id)
     where name like 'SERVICE DUMP%'),
  {_CATALOGUE}, inside as (select l.*, parent_section, parent_start, e from lines l join parents p on l.report_id = p.report_id and line_number between parent_start and e),
  held as (select report_id, line_number, parent_section, parent_start, e, arg_min(cat, i) c from inside, cat where {_HOLDS} group by all)
  select report_id, parent_section, parent_start, c.name as name, c.pattern as pattern, line_number start_line,
    coalesce(lead(line_number) over (partition by report_id, parent_start order by line_number) - 1, e) end_line, c.priority as priority, c.category as category
  from held""")
def subsections_by_parent(spark, d):
    names = ("SERVICE DUMP CRITICAL (dumpview)", "SERVICE DUMP NORMAL (dumpview)")
    return sections.subsections_in(_rows(spark, d), _sections(spark, d), {n: _SERVICES for n in names})


_BOTH = f"""{_SECTIONS}, {_SUBS}, both_ as (select *, row_number() over (partition by report_id order by start_line, r) as position
    from (select *, 0 r from secs union all select *, 1 r from subs))"""


def _both(spark, d) -> DataFrame:
    return sections.union_sections(_sections(spark, d), _subsections(spark, d))


@named(f"with {_BOTH} select * exclude (r) from both_")
def all_sections(spark, d):
    return _both(spark, d)


@named(f"""with {_BOTH} select b.report_id, b.start_line, b.position, b.level,
    (select max_by(p.start_line, p.position) from both_ p where p.report_id = b.report_id and p.position < b.position and p.level < b.level) parent_start from both_ b""")
def section_tree(spark, d):
    return sections.section_tree(_both(spark, d), ("position",)).select("report_id", "start_line", "position", "level", "parent_start")


@named(f"""with {_SECTIONS} select l.report_id, l.line_number, s.start_line section_start, s.name
    from lines l asof join secs s on l.report_id = s.report_id and l.line_number >= s.start_line""")
def line_sections(spark, d):
    found = sections.covering(_places(spark, d), _sections(spark, d).select("report_id", "start_line", "end_line", "name"))
    return found.select("report_id", "line_number", F.col("start_line").alias("section_start"), "name")


# ------------------------------------------------------------------ keywords
_KEYWORDS = catalog.preset_keywords()
_KW = "kw as (select unnest([" + ", ".join(f"'{k}'" for k in _KEYWORDS) + "]) keyword)"
_KEY_INDEX = f"{_LINES}, {_KW}, ki as (select keyword, report_id, line_number from lines, kw where contains(lower(content), keyword))"


def _keyword_index(spark, d) -> DataFrame:
    return index.keyword_index(_rows(spark, d), _KEYWORDS).distinct()  # hits are shuffled, and each row is looked at once


@named(f"with {_KEY_INDEX} select * from ki")
def keyword_index(spark, d):
    return _keyword_index(spark, d)


@named(f"with {_KEY_INDEX} select kw.keyword, count(line_number) n_hits from kw left join ki using (keyword) group by 1")
def keyword_index_full(spark, d):
    return index.keyword_counts(_keyword_index(spark, d), _KEYWORDS)


@named(f"with {_KEY_INDEX} select keyword, report_id, list_aggregate(list_sort(list(distinct line_number)), 'string_agg', ',') line_numbers from ki group by 1, 2")
def keyword_index_wide(spark, d):
    return index.wide_index(_keyword_index(spark, d)).withColumn("line_numbers", F.array_join("line_numbers", ","))


_CONFIG = Config(
    {
        "keywords": catalog.KEYWORDS,
        "record_types": {"log": {"keywords": ["ANR", "watchdog"], "category": "logcat", "subsections": [{"name": "radio", "keywords": ["Cell"], "category": "phone"}]}, "kernel": {"keywords": ["Binder", "anr"], "category": "kernel"}},
        "interest_points": [{"name": "deaths", "keywords": ["died", "CELL"], "priority": "HIGH"}],
    }
)


@named("""select * from (values ('anr', 'record_type', 'kernel', cast(null as varchar), 'kernel', null), ('binder', 'record_type', 'kernel', null, 'kernel', null),
    ('cell', 'interest_point', 'deaths', null, null, 'HIGH'), ('died', 'interest_point', 'deaths', null, null, 'HIGH'), ('watchdog', 'record_type', 'log', null, 'logcat', null))
    t(keyword, type, name, parent, category, priority)""")
def keyword_provenance(spark, d):
    return spark.createDataFrame(catalog.keyword_provenance(_CONFIG), "keyword string, type string, name string, parent string, category string, priority string")


_SCAN = "select report_id, line_number, content, '{0}' keyword from lines where contains(lower(content), lower('{0}'))"


@named(f"with {_LINES} {_SCAN.format('Timed Out')}")
def preset_query(spark, d):
    lines = _lines(spark, d)
    return query.preset(lines, index.keyword_index(lines, ["timed out", "warn"]), "Timed Out")


@named(f"with {_LINES} {_SCAN.format('I/O on')}")
def custom_keyword(spark, d):
    return query.Router(_lines(spark, d), _KEYWORDS).query("I/O on")


@named(f"with {_LINES} select report_id, line_number, content from lines where regexp_matches(content, 'lost: reason=(?P<r>\\d+)', 'i')")
def custom_regex(spark, d):
    cond = query.condition(query.Query("q", "regex", r"lost: reason=(?P<r>\d+)"), F.col("content"))
    return _lines(spark, d).where(cond)


@named(f"""with {_SECTIONS}, ends as (select report_id, max(line_number) e from lines group by 1)
    select distinct l.* from lines l join secs s on l.report_id = s.report_id join ends on l.report_id = ends.report_id
    where contains(lower(name), 'kernel') and line_number between start_line and case when end_line = 0 then e else end_line end""")
def custom_section(spark, d):
    return query.section_matches(_rows(spark, d), _sections(spark, d), "Kernel")


_MANY = f"""{_LINES}, q as materialized (select * from custom_queries where enabled and pattern <> '' and name <> 'broken_regex'),
  kh as (select name query_name, report_id, line_number from lines, q where type = 'keyword' and contains(lower(content), lower(pattern))),
  rh as (select 'everything' query_name, report_id, line_number from lines where regexp_matches(content, '.', 'i')
    union all select 'link_losses', report_id, line_number from lines where regexp_matches(content, 'lost: reason=\\d+', 'i')
    union all select 'slow_paths', report_id, line_number from lines where regexp_matches(content, '(slow|timed out|deadline)', 'i')
    union all select 'deaths', report_id, line_number from lines where regexp_matches(content, '(?P<what>died|crash)', 'i')
    union all select 'late_fences', report_id, line_number from lines where regexp_matches(content, 'fence \\d+ signalled', 'i')
    union all select 'sector_io', report_id, line_number from lines where regexp_matches(content, 'sector \\d+ took', 'i')),
  hits as (select * from kh union all select * from rh)"""


def _many(spark, d) -> DataFrame:
    return query.many(_rows(spark, d), query.QuerySet.from_table(table(spark, d, "custom_queries"))).distinct()


@named(f"with {_MANY} select * from hits")
def multi_query(spark, d):
    return _many(spark, d)


_SUMMARY = f"""{_MANY}, summary_ as (select c.name query_name, c.type, c.pattern, c.priority, count(h.line_number) match_count
    from custom_queries c left join hits h on h.query_name = c.name where c.name is not null group by all)"""


@named(f"with {_SUMMARY} select * from summary_")
def multi_query_summary(spark, d):
    return query.summary(_many(spark, d), table(spark, d, "custom_queries"))


@named(f"""with {_SUMMARY} select *, case upper(priority) when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 when 'LOW' then 4 else 5 end priority_rank from summary_""")
def priority_sorted(spark, d):
    return query.by_priority(query.summary(_many(spark, d), table(spark, d, "custom_queries"))).orderBy("priority_rank", "query_name")


@named("""select 'custom' source, query_name, report_id, line_number from (select query_name, report_id, unnest(line_numbers) line_number from custom_index where (type = 'keyword' and lower(pattern) = 'memory') or (type = 'regex' and pattern = '.'))
    where line_number is not null union all select 'preset', null, report_id, line_number from enhanced_index where lower(keyword) = 'memory' and line_number is not null""")
def index_query(spark, d):
    return query.index_query("Memory", table(spark, d, "enhanced_index"), table(spark, d, "custom_index"))


@named("""select 'custom' source, query_name, report_id, line_number from (select query_name, report_id, unnest(line_numbers) line_number from custom_index
      where (type = 'keyword' and lower(pattern) = 'slow') or (type = 'regex' and pattern in ('.', '(slow|timed out|deadline)'))) where line_number is not null""")
def index_query_reverse(spark, d):
    return query.index_query("slow", table(spark, d, "enhanced_index"), table(spark, d, "custom_index"), use_preset=False)


@named("""with c as (select report_id, count(*) n from (select report_id, unnest(line_numbers) x from custom_index where (type = 'keyword' and lower(pattern) = 'memory') or (type = 'regex' and pattern = '.')) where x is not null group by 1),
    p as (select report_id, count(*) n from enhanced_index where lower(keyword) = 'memory' and line_number is not null group by 1)
    select report_id, case when c.n is null then 'enhanced_index' when p.n is null then 'custom_index' else 'custom_index,enhanced_index' end sources, coalesce(c.n, 0) + coalesce(p.n, 0) total_matches
    from c full join p using (report_id)""")
def index_answer(spark, d):
    return query.index_answer(index_query(spark, d)).withColumn("sources", F.array_join("sources", ","))


@named(f"""with {_LINES}, k as (select unnest(['anr', 'i/o on']) keyword) select keyword, report_id, line_number from lines, k where contains(lower(content), keyword)""")
def routed_queries(spark, d):
    """One keyword by the index, one by a pass over the lines, as the router decides."""
    lines = _lines(spark, d)
    router = query.Router(lines, _KEYWORDS, index.keyword_index(lines, _KEYWORDS))
    assert router.is_preset("ANR") and not router.is_preset("I/O on")
    return router.query("ANR").unionByName(router.query("I/O on")).select(F.lower("keyword").alias("keyword"), "report_id", "line_number")


@named(f"with {_LINES} select 'anr' keyword, report_id, line_number from lines where line_number <= 50 and contains(lower(content), 'anr')")
def keyword_index_limited(spark, d):
    return index.keyword_index(L.up_to(_lines(spark, d), 50), ["ANR"])


@named(f"with {_KEY_INDEX}, {_SECTIONS.removeprefix(_LINES + ',')} select 'keywords' name, count(*) n_rows from ki union all select 'sections', count(*) from secs union all select 'queries', null")
def saved_indexes(spark, d):
    """Indexes saved and loaded again; one that isn't there is reported."""
    root = f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}"
    save_index(_keyword_index(spark, d), f"{root}/keywords")
    save_index(_sections(spark, d), f"{root}/sections")
    found = load_indexes(spark, root)
    counts = [f.agg(F.count("*").alias("n_rows")) if f is not None else spark.sql("select cast(null as bigint) n_rows") for f in found.values()]
    return reduce(DataFrame.unionByName, [c.select(F.lit(name).alias("name"), "n_rows") for name, c in zip(found, counts)])


# ------------------------------------------------------------------ context and pages
@named(f"""with {_LINES}, h as (select report_id, line_number hit_line from lines where contains(lower(content), 'policy denies'))
    select h.report_id, hit_line, case when l.line_number < hit_line then 'before' when l.line_number > hit_line then 'after' else 'hit' end side, l.line_number,
      regexp_replace(content, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x0b]+$', '') as content
    from h join lines l on l.report_id = h.report_id and l.line_number between hit_line - 2 and hit_line + 2""")
def context_window(spark, d):
    return context.context_lines(_rows(spark, d), query.keyword_lines(_rows(spark, d), "policy denies"), 2, 2).distinct()


@named(f"""with {_LINES}, h as (select report_id, total_lines - 1 hit_line from reports union select report_id, total_lines + 5 from reports)
    select h.report_id, hit_line, case when l.line_number < hit_line then 'before' when l.line_number > hit_line then 'after' else 'hit' end side, l.line_number,
      regexp_replace(content, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x0b]+$', '') as content
    from h join lines l on l.report_id = h.report_id and l.line_number between hit_line - 1 and hit_line + 1
    union all select h.report_id, hit_line, 'hit', hit_line, '' from h where not exists (from lines l where l.report_id = h.report_id and l.line_number = hit_line)""")
def context_tolerant(spark, d):
    ends = table(spark, d, "reports").select("report_id", F.explode(F.array(F.col("total_lines") - 1, F.col("total_lines") + 5)).alias("line_number"))
    return context.context_lines(_rows(spark, d), ends, 1, 1, tolerant=True).distinct()


_PAGES = f"""{_MANY}, p as (select query_name, (row_number() over (partition by query_name order by report_id, line_number) - 1) // 116 + 1 as part, report_id, line_number from hits)"""


def _pages(spark, d) -> DataFrame:
    return context.pages(_many(spark, d), context.page_size())


@named(f"with {_PAGES} select * from p")
def paginate(spark, d):
    return _pages(spark, d)


@named(f"with {_PAGES} select query_name, count(*) total_results, max(part) total_parts from p group by 1")
def page_summary(spark, d):
    return context.page_summary(_pages(spark, d))


@named(f"""with {_PAGES}, n as (select query_name, part, count(*) results_in_part, min((report_id, line_number)) a from p group by 1, 2)
    select query_name, part current_part, max(part) over (partition by query_name) total_parts, results_in_part, a[1] first_report, a[2] first_line from n""")
def written_pages(spark, d):
    """Pages with their places, as the page sink writes and reads them."""
    paged = _pages(spark, d)
    places_ = paged.select("report_id", "line_number").distinct()
    about = table(spark, d, "custom_queries").where("name is not null").select(F.col("name").alias("query_name"), "type", "pattern", "priority", "description")
    root = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    context.write_pages(paged, places_, context.result_rows(paged, about), root)
    first = F.element_at("results", 1)
    return spark.read.json(f"{root}/context").select("query_name", "pagination.*", first["report_id"].alias("first_report"), first["line_number"].alias("first_line"))


@named(f"""with {_PAGES}, f as (select query_name, count(*) total_matches, max(part) total_parts, max(part) + 2 files_created, list((report_id, line_number) order by report_id, line_number)[:100] l from p group by 1)
    select f.query_name, c.type, total_matches, total_parts, files_created, 116 results_per_part, len(l) n_listed, l[-1][1] last_report, l[-1][2] last_line from f join custom_queries c on c.name = f.query_name""")
def result_summaries(spark, d):
    about = table(spark, d, "custom_queries").where("name is not null").select(F.col("name").alias("query_name"), "type", "pattern", "priority", "description")
    last = F.element_at("line_numbers", -1)
    rows = context.result_rows(_pages(spark, d), about)
    return rows.select("query_name", "type", "total_matches", "total_parts", "files_created", "results_per_part", F.size("line_numbers").alias("n_listed"), last["report_id"].alias("last_report"), last["line_number"].alias("last_line"))


@named(f"with {_LINES} select report_id, line_number from lines where contains(lower(content), 'wakelock') order by 1, 2 limit 30")
def first_hits(spark, d):
    return context.first_hits(query.keyword_lines(_rows(spark, d), "wakelock").distinct(), 30)


# ------------------------------------------------------------------ fields and times
def _fields_sql(pattern: str) -> str:
    regex, names = catalog.LINE_PATTERNS[pattern]
    return f"with {_LINES} select report_id, line_number, " + ", ".join(f"nullif(regexp_extract(content, '{regex}', {i}), '') as {n}" for i, n in enumerate(names, 1)) + f" from lines where regexp_matches(content, '{regex}')"


def _fields(pattern):
    return lambda spark, d: timing.line_fields(_lines(spark, d), pattern)


for _p in catalog.LINE_PATTERNS:
    QUERIES[f"{_p}_fields"], ORACLES[f"{_p}_fields"] = _fields(_p), _fields_sql(_p)

_YEAR = 2024
_TIMES = rf"""{_LINES}, squeezed as (select report_id, line_number, content,
      regexp_replace(regexp_extract(content, '^(\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})', 1), '\s+', ' ', 'g') lc, regexp_extract(content, '^\[\s*(\d+\.\d+)\]', 1) ke,
      regexp_replace(regexp_extract(content, 'ending at:\s+(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}})', 1), '\s+', ' ', 'g') du,
      regexp_replace(regexp_extract(content, '^(\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}})', 1), '\s+', ' ', 'g') sy from lines),
  times as (select report_id, line_number, case when lc <> '' then 'logcat' when ke <> '' then 'kernel' when du <> '' then 'dumpsys' when sy <> '' then 'system' end time_format,
      case when lc <> '' then try_cast('{_YEAR}-' || lc as timestamp) when ke <> '' then cast(make_timestamp(cast(cast(ke as decimal(20, 6)) * 1000000 as bigint)) as timestamp)
           when du <> '' then try_cast(du as timestamp) when sy <> '' then try_cast('{_YEAR}-' || sy as timestamp) end ts from squeezed)"""


@named(f"with {_TIMES} select * from times where ts is not null")
def parse_time(spark, d):
    return timing.timed(_lines(spark, d), _YEAR)


@named(f"with {_TIMES} select * from times where ts between timestamp '{_YEAR}-03-01 00:00:00' and timestamp '{_YEAR}-08-31 12:00:00'")
def time_range(spark, d):
    return timing.between(timing.timed(_lines(spark, d), _YEAR), f"{_YEAR}-03-01 00:00:00", f"{_YEAR}-08-31 12:00:00")


@named(f"""with {_TIMES}, h as (select distinct t.report_id, t.ts from times t join lines l using (report_id, line_number) where contains(lower(content), 'anr suspected'))
    select distinct t.report_id, t.line_number from times t join h on t.report_id = h.report_id and t.ts between h.ts - interval 30 second and h.ts + interval 10 second""")
def time_context(spark, d):
    lines = _lines(spark, d)
    return timing.time_context(timing.timed(lines, _YEAR), query.keyword_lines(lines, "ANR suspected"), 30, 10)


# ------------------------------------------------------------------ tokens and composite queries
_TOKENS = r"""tokens as (select distinct doc_id, token from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) token from documents where text is not null)
    where length(token) > 2 and token not in ('the','a','an','and','or','in','on','at','to','for'))"""


def _tokens(spark, d) -> DataFrame:
    return index.token_index(table(spark, d, "documents"), "doc_id", "text")


@named(f"with {_TOKENS} select token, count(*) n_documents from tokens group by 1")
def token_index(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("n_documents"))


@named(f"with {_TOKENS} select doc_id from tokens where token in ('wakelock', 'ticket') group by 1 having count(distinct token) = 2")
def token_and(spark, d):
    return index.with_all(_tokens(spark, d), ["Wakelock", "ticket"], "doc_id")


@named(f"with {_TOKENS} select distinct doc_id from tokens where token in ('wakelock', 'geofence')")
def token_or(spark, d):
    return index.with_any(_tokens(spark, d), ["wakelock", "geofence"], "doc_id")


@named(f"""with {_TOKENS} select doc_id, lang as record_type, created_at as ts from documents where lang in ('en', 'de')
    and created_at between timestamp '2024-01-01' and timestamp '2025-12-31' and doc_id in (select doc_id from tokens where token in ('archive', 'wakelock') group by 1 having count(*) >= 2)""")
def composite_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("record_type"), F.col("created_at").alias("ts"))
    return query.composite(docs, _tokens(spark, d), "doc_id", ["en", "de"], ("2024-01-01", "2025-12-31"), ["archive", "wakelock"])


@named(f"""with {_SECTIONS}, ends as (select report_id, max(line_number) e from lines group by 1)
    select distinct l.* from lines l join secs s on l.report_id = s.report_id join ends on l.report_id = ends.report_id
    where contains(lower(name), 'platform') and line_number between start_line and case when end_line = 0 then e else end_line end and contains(lower(content), 'alarm')""")
def mini_language(spark, d):
    lines = _lines(spark, d)
    return language.run('SELECT * FROM section = "platform" WHERE keyword = "alarm"', lines, sections.detect_sections(lines), _YEAR, f"{_YEAR}-01-01")


@named(f"""with {_TIMES}, hit as (select l.report_id, l.line_number, ts from lines l join times t using (report_id, line_number)
      where ts between timestamp '{_YEAR}-03-09 00:00:00' and timestamp '{_YEAR}-06-30 00:00:00' and contains(lower(content), 'anr'))
    select l.* from lines l where exists (from hit h where h.report_id = l.report_id and h.line_number = l.line_number)
      or exists (from times t join hit h on t.report_id = h.report_id and t.ts between h.ts - interval 30 second and h.ts + interval 30 second where t.report_id = l.report_id and t.line_number = l.line_number)""")
def mini_language_time(spark, d):
    lines = _lines(spark, d)
    text = f'SELECT * WHERE keyword = "ANR" AND time BETWEEN "{_YEAR}-03-09 00:00:00" AND "{_YEAR}-06-30 00:00:00" BEFORE 30s AND AFTER 30s'
    return language.run(text, lines, sections.detect_sections(lines), _YEAR, f"{_YEAR}-01-01")


# ------------------------------------------------------------------ blocks, chunks, integrity
_OPENS = " ".join(f"when regexp_matches(content, '{k[2]}') then {i}" for i, k in enumerate(blocks.BLOCK_KINDS))
_ENDED = " ".join(f"when k = {i} then coalesce(min(line_number) filter (line_number > s and regexp_matches(content, '{k[3]}')), max(line_number))" if k[3] else f"when k = {i} then s" for i, k in enumerate(blocks.BLOCK_KINDS))
_KIND = lambda j: "case k " + " ".join(f"when {i} then '{k[j]}'" for i, k in enumerate(blocks.BLOCK_KINDS)) + " end"
_BLOCKS = f"""{_LINES}, opened as (select *, case {_OPENS} end o from lines),
  owned as (select *, max(case when o is not null then line_number end) over (partition by report_id order by line_number) s from opened),
  kinds as (select *, max(case when line_number = s then o end) over (partition by report_id, s) k from owned where s is not null),
  blocks_ as (select report_id, {_KIND(0)} as type, s start_line, case {_ENDED} end end_line, {_KIND(1)} as priority from kinds group by report_id, s, k)"""


def _blocks(spark, d) -> DataFrame:
    return blocks.record_blocks(_rows(spark, d), unique=False)


@named(f"with {_BLOCKS} select * from blocks_")
def record_blocks(spark, d):
    return _blocks(spark, d)


@named(f"with {_BLOCKS} select * from blocks_ where end_line - start_line + 1 >= 10")
def fine_chunks(spark, d):
    return blocks.fine_chunks(_blocks(spark, d))


# Record types of the test reports' own sections, which go after the catalogue's.
_TYPES_OWN = (
    ("structured", "MEDIUM", "logcat", "^------ STRUCTURED FEED", r"^------ \d+\.\d+s was the duration of 'STRUCTURED FEED"),
    ("radio", "HIGH", "logcat", "^------ RADIO JOURNAL", "^------ [A-Z]"),
)
_TYPES_SQL = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in _TYPES_OWN)


@named(f"""with {_LINES}, types(record_type, priority, category, opens, closes) as (values {expected.RECORD_TYPES}, {_TYPES_SQL}),
    m as (select types.*, report_id, line_number, regexp_matches(content, '^(?:' || opens || ')') st, regexp_matches(content, '^(?:' || closes || ')') en
      from lines, types where left(content, 1) in ('=', '-', '#', '*') or (content = '' and record_type = 'battery_log')),
    ends as (select report_id, max(line_number) report_end from lines group by 1)
    select report_id, record_type, priority, category, line_number start_line,
      coalesce((select min(x.line_number) from m x where x.en and x.report_id = m.report_id and x.record_type = m.record_type and x.line_number > m.line_number), report_end) end_line
    from m join ends using (report_id) where st""")
def record_types(spark, d):
    return blocks.record_types(_rows(spark, d), (*catalog.RECORD_TYPES, *_TYPES_OWN), unique=False)


@named(f"""with {_LINES}, mb as (select report_id, sum(octet_length(encode(content)) + 1) / 1e6 mb from lines group by 1)
    select report_id, case when mb < 10 then 'fine' when mb < 100 then 'record' else 'chapter' end strategy from mb""")
def chunk_strategy(spark, d):
    sized = _rows(spark, d).select("report_id", "line_number", (F.octet_length("content") + 1).alias("n")).distinct().groupBy("report_id").agg((F.sum("n") / 1e6).alias("mb"))
    return sized.select("report_id", blocks.strategy(F.col("mb")).alias("strategy"))


_CHAPTER = " or ".join(f"starts_with(ltrim(content), '{m}')" for m in blocks.CHAPTER_MARKERS)


@named(f"""with {_LINES}, b as (select *, {_CHAPTER} bg from lines),
  o as (select *, coalesce(max(case when bg then line_number end) over (partition by report_id order by line_number), 0) s from b)
  select report_id, min(line_number) start_line, max(line_number) end_line, count(*) n_lines, cast(sum(octet_length(encode(content))) as bigint) n_bytes,
    case when s = 0 then 'header' else max(case when bg then trim(content) end) end chapter from o group by report_id, s""")
def chapter_chunks(spark, d):
    return blocks.chapter_chunks(_rows(spark, d), unique=False)


_CHUNKS = f"""{_LINES}, o as (select report_id, line_number, octet_length(encode(content)) + 1 b, coalesce(sum(octet_length(encode(content)) + 1)
      over (partition by report_id order by line_number rows between unbounded preceding and 1 preceding), 0) before from lines),
  chunks as (select report_id, cast(before // 8192 as bigint) chunk_no, min(line_number) start_line, max(line_number) end_line, cast(sum(b) as bigint) n_bytes, cast(min(before) as bigint) byte_offset from o group by 1, 2)"""


@named(f"with {_CHUNKS} select * from chunks")
def record_chunks(spark, d):
    return blocks.record_chunks(_rows(spark, d), 8192, unique=False)


@named(f"with {_CHUNKS} select report_id, count(*) n_chunks, cast(sum(n_bytes) as bigint) n_bytes from chunks group by 1")
def chunk_stats(spark, d):
    return blocks.record_chunks(_rows(spark, d), 8192, unique=False).groupBy("report_id").agg(F.count("*").alias("n_chunks"), F.sum("n_bytes").alias("n_bytes"))


_RECORDS = """records as (select distinct report_id, lower(trim(section_type)) record_type, start_line, case when end_line = 0 then total_lines else least(end_line, total_lines) end end_line
    from sections join reports using (report_id) where section_type is not null)"""


def _records(spark, d) -> DataFrame:
    """The sections' own types as records."""
    ends = table(spark, d, "reports").select("report_id", "total_lines")
    last = F.when(F.col("end_line") == 0, F.col("total_lines")).otherwise(F.least("end_line", "total_lines"))
    return table(spark, d, "sections").where("section_type is not null").join(ends, "report_id").select("report_id", F.lower(F.trim("section_type")).alias("record_type"), "start_line", last.alias("end_line")).distinct()


@named(f"""with {_LINES}, {_RECORDS}, o as (select report_id, line_number, octet_length(encode(content)) + 1 b, coalesce(sum(octet_length(encode(content)) + 1)
      over (partition by report_id order by line_number rows between unbounded preceding and 1 preceding), 0) // 2048 k from lines),
  bk as (select report_id, record_type, start_line record_start, k, min(line_number) s, max(line_number) e, sum(b) b from o join records r using (report_id) where line_number between r.start_line and r.end_line group by all),
  f as (select *, case when row_number() over w = 1 or (record_type <> 'logcat' and sum(b) over (partition by report_id, record_type, record_start) > 4096 and b >= 512) then 1 else 0 end g from bk window w as (partition by report_id, record_type, record_start order by k)),
  c as (select *, sum(g) over (partition by report_id, record_type, record_start order by k) c from f)
  select report_id, record_type, record_start, min(s) start_line, max(e) end_line, cast(sum(b) as bigint) n_bytes from c group by report_id, record_type, record_start, c""")
def section_chunks(spark, d):
    return blocks.section_chunks(_rows(spark, d), _records(spark, d), 2048, 512, 4096, ("logcat",), unique=False)


@named(f"with {_RECORDS} select record_type, count(*) n_chunks from records group by 1")
def type_list(spark, d):
    return index.list_types(_records(spark, d))


@named(f"with {_RECORDS} select * from records where record_type in ('logcat', 'kernel')")
def of_types(spark, d):
    return index.of_types(_records(spark, d), "logcat", "kernel")


@named("""select doc_id, lang record_type, created_at ts from documents where (lang in ('en', 'de') and created_at between timestamp '2024-06-01' and timestamp '2025-06-30') or doc_id between 1000 and 5000000""")
def stored_chunks(spark, d):
    """Chunks stored and read again by type and time, and by range of ids."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("record_type"), F.col("created_at").alias("ts"))
    root = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    blocks.store_chunks(docs, root)
    by = blocks.read_chunks(spark, root, types=["en", "de"], times=("2024-06-01", "2025-06-30"))
    return by.unionByName(blocks.read_chunks(spark, root, id_range=(1000, 5_000_000), key="doc_id")).select("doc_id", "record_type", "ts").distinct()


@named("select doc_id from documents where text is not null and md5(text) <> md5(trim(text))")
def verified(spark, d):
    """Texts that don't have the checksum of their trimmed form."""
    return blocks.verify(table(spark, d, "documents").where("text is not null").withColumn("kept", F.md5(blanks_trimmed(F.col("text")))), "text", "kept").select("doc_id")


@named("select doc_id, md5(text) md5, sha256(text) sha256 from documents")
def chunk_checksum(spark, d):
    return blocks.checksums(table(spark, d, "documents"), "doc_id", "text")


_DUMPS = """ranges as (select distinct report_id, start_line, case when end_line = 0 then total_lines else end_line end end_line from sections join reports using (report_id)
    where not contains(name, 'DUMP'))"""


def _ranges(spark, d) -> DataFrame:
    """Line ranges of the sections that aren't dumps."""
    ends = table(spark, d, "reports").select("report_id", "total_lines")
    return table(spark, d, "sections").join(ends, "report_id").where(~F.contains("name", F.lit("DUMP"))).select("report_id", "start_line", F.when(F.col("end_line") == 0, F.col("total_lines")).otherwise(F.col("end_line")).alias("end_line")).distinct()


@named(f"""with {_DUMPS}, wide as (select report_id, start_line, end_line + 3 end_line from ranges)
    select report_id, start_line, end_line, r reached from (select *, max(end_line) over (partition by report_id order by start_line, end_line rows between unbounded preceding and 1 preceding) r from wide) where r >= start_line""")
def boundary_overlaps(spark, d):
    return blocks.overlaps(_ranges(spark, d).withColumn("end_line", F.col("end_line") + 3))


@named(f"""with {_DUMPS}, e as (select report_id, start_line, end_line from ranges union all select report_id, total_lines + 1, total_lines + 1 from reports),
  r as (select *, coalesce(max(end_line) over (partition by report_id order by start_line, end_line rows between unbounded preceding and 1 preceding), 0) reach from e)
  select report_id, reach + 1 gap_start, start_line - 1 gap_end from r where start_line > reach + 1""")
def boundary_gaps(spark, d):
    return blocks.gaps(_ranges(spark, d), table(spark, d, "reports").select("report_id", F.col("total_lines").alias("report_end")))


@named(f"""with {_DUMPS}, g as (select *, start_line - lag(end_line) over w - 1 as gap from (select report_id, start_line, end_line - 4 end_line from ranges where end_line - 4 >= start_line) window w as (partition by report_id order by start_line)),
  i as (select *, sum(case when gap > 0 and gap < 10 then 0 else 1 end) over (partition by report_id order by start_line) island from g)
  select report_id, min(start_line) start_line, max(end_line) end_line, count(*) n_joined from i group by report_id, island""")
def gap_repair(spark, d):
    return blocks.repaired(_ranges(spark, d).withColumn("end_line", F.col("end_line") - 4).where("end_line >= start_line"))


@named(f"""with {_LINES}, k as (select unnest(['logcat', 'anr', 'tombstone', 'property']) kind) select report_id, line_number, kind, case kind
      when 'anr' then contains(content, '----- pid') and contains(content, '----- end') when 'tombstone' then contains(content, '*** *** ***')
      when 'logcat' then regexp_matches(content, '^\\d{{2}}-\\d{{2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}}') else true end is_whole from lines, k""")
def record_completeness(spark, d):
    kinds = F.explode(F.array(*map(F.lit, ("logcat", "anr", "tombstone", "property"))))
    rows = _rows(spark, d).select("report_id", "line_number", "content", kinds.alias("kind"))
    return rows.select("report_id", "line_number", "kind", blocks.complete(F.col("kind"), F.col("content")).alias("is_whole")).distinct()


_NUMBER = r"try_cast(nullif(regexp_extract(content, '(\d+(?:\.\d+)?)\s*(?:ms|frames|count)', 1), '') as double)"


def _rule_sql(domain, focus, pattern, name, least) -> str:
    match = f"regexp_matches(content, '{pattern}', 'i')" + (f" and {_NUMBER} > {least}" if name else "")
    shown = f"'{name}'" if name else "null"
    return f"select report_id, line_number, '{domain}' as domain, '{focus}' focus, {shown} threshold_name, {_NUMBER if name else 'cast(null as double)'} as value from lines where {match}"


@named(f"with {_LINES} " + " union all ".join(_rule_sql(*r) for r in expected.KNOWLEDGE))
def knowledge_tags(spark, d):
    return query.tagged(_rows(spark, d), catalog.KNOWLEDGE).distinct()
