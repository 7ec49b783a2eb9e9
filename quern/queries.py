"""Registered queries of the engine and their DuckDB equivalents.

The mapping of the driver tables: a document is a note (id + 1) with one field, tags
language and source, deck ``language::source``; an order is a note and its lines are
cards; events are a change feed; embeddings are vectors of notes.

Searches read an index that the first of them publishes, in the folder that the cluster
shares, once for each session and data folder. Other queries read the tables.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import actions, changes, fusion, fuzzy, index, lexical, related, vectors
from quern.operators.search import Engine, Index
from quern.operators.versions import Versions
from quern.plans.parser import Parser
from quern.plans.predicates import compile_filter
from quern.plans.scopes import Scope, visible_decks
from quern.sources.notes import card_state, documents_as_notes, home_deck, table

TOP = 50
ALIASES = [("loser", "moron"), ("stupid", "idiot"), ("clown", "scum"), ("plan b", "idiot")]
MISSPELLED = ["pathetc", "worthles", "stupdi", "disgustng", "wortlhess", "pathetical", "morno", "clwon", "ththe", "thingg"]
SMART_QUERIES = ["stupid idiot", '"the" moron', "worthles loser", "trash -clown", "deck:en pathetic", "thing and stupid scum moron", "tag:src1 disgusting", "note:fr", "is:"]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from quern import upkeep_queries

    return {**_QUERIES, **upkeep_queries.queries()}


def oracle_sql() -> dict[str, str]:
    from quern import upkeep_queries

    return {**_SQL, **upkeep_queries.oracle_sql()}


# --- shared SQL and frames ----------------------------------------------------------

_WORD = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*"
_TOK = r"[\p{L}\p{N}]+"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(replace(replace({x}, 'ß', 'ss'), '…', '...'))), '\s+', ' ', 'g'))"


_PREP = rf"""
plain as (select doc_id + 1 as note_id, lang, source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as plain from documents),
prep as (select *, case when plain = '' then 'Note ' || note_id when length(plain) <= 180 then plain else rtrim(substr(plain, 1, 179)) || '…' end as title from plain),
texts as (select note_id, lang, source, title, plain, {_norm("concat_ws(' ', nullif(title, ''), nullif(plain, ''), lang || ' ' || source, lang || '::' || source, lang)")} as normalized_text,
          {_norm("concat_ws(' ', nullif(plain, ''), lang || ' ' || source, lang || '::' || source, lang)")} as vocabulary_text from prep)"""
_COUNTS = f"""
cols as (
  select note_id, 'title' as col, 8.0 as w, regexp_extract_all({_norm("title")}, '{_TOK}') as toks from prep union all
  select note_id, 'body', 3.0, regexp_extract_all({_norm("plain")}, '{_TOK}') from prep union all
  select note_id, 'tags', 4.0, regexp_extract_all({_norm("lang || ' ' || source")}, '{_TOK}') from prep union all
  select note_id, 'decks', 2.5, regexp_extract_all({_norm("lang || '::' || source")}, '{_TOK}') from prep union all
  select note_id, 'note_type', 2.5, regexp_extract_all({_norm("lang")}, '{_TOK}') from prep),
occ as (select note_id, col, w, unnest(toks) as term from cols),
tc as (select term, note_id, sum(w) as wf from occ group by all),
lens as (select note_id, sum(len(toks)) as len from cols group by 1),
corpus as (select count(*) as n, avg(len) as mean from lens)"""
_TERMS = f"""
bench as (select item_id, term, row_number() over (partition by item_id order by length(term) desc, term) as g
          from (select distinct item_id, unnest(regexp_extract_all({_norm("text")}, '{_TOK}')) as term from benchmark))"""


def _match(terms: str) -> str:
    """Scores of all notes for ``terms(query_id, group_id, term)``."""
    return f"""
asked as ({terms}),
dfs as (select term, count(*) as df from tc where term in (select term from asked) group by 1),
m as (select query_id, note_id, -sum(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * wf * 2.2 / (wf + 1.2 * (0.25 + 0.75 * len / mean))) as score,
             count(distinct group_id) as groups
      from asked join tc using (term) join dfs using (term) join lens using (note_id), corpus group by all),
wanted as (select query_id, count(distinct group_id) as wanted from asked group by 1)"""


def _rank(source: str, cap: int = TOP) -> str:
    return f"select query_id, note_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9), note_id) as rank from ({source})) where rank <= {cap}"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_notes(table(spark, d, "documents"))


def workspace(spark: SparkSession) -> str:
    """A folder of this session that all executors share.

    It lies in ``spark.checkpoint.dir``, or in the context's checkpoint folder. Only a
    local session may go without both, and then uses the machine's temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "quern-workspace")
        atexit.register(shutil.rmtree, f"{shared}/quern-{spark.sparkContext.applicationId}", ignore_errors=True)
    return f"{shared}/quern-{spark.sparkContext.applicationId}"


_OPEN: dict[tuple[str, str], Index] = {}


def _index(spark: SparkSession, d: str) -> Index:
    """The published index of a data folder's documents; built once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _OPEN:
        root = f"{workspace(spark)}/index-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
        versions = Versions(spark, root)
        if not versions.has("prepared"):
            index.publish(versions, _notes(spark, d), spark.createDataFrame(ALIASES, "alias string, canonical string"), single_field=True)
        _OPEN[key] = Index.open(versions)
    return _OPEN[key]


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return index.prepare_single_field(_notes(spark, d))


def _bench_terms(spark: SparkSession, d: str, n: int | None = None) -> DataFrame:
    """(query_id, group_id, term): the distinct words of each benchmark text, longest first; the first n, or all."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(T.index_tokens(T.normalize(F.col("text")))).alias("term")).distinct()
    w = Window.partitionBy("item_id").orderBy(F.desc(F.char_length("term")), "term")
    words = words.withColumn("group_id", F.row_number().over(w))
    return (words if n is None else words.where(F.col("group_id") <= n)).select(F.col("item_id").alias("query_id"), "group_id", "term")


def _scored(spark: SparkSession, d: str, terms: DataFrame) -> DataFrame:
    idx = _index(spark, d)
    return lexical.matched(lexical.word_parts(idx.counts, idx.terms, terms, idx.corpus, idx.shards))


def _top(matches: DataFrame, cap: int = TOP) -> DataFrame:
    best = lexical.ranked(matches, cap, [F.round("score", 9)])
    return best.select("query_id", "note_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


# --- text and index -----------------------------------------------------------------


@query(f"""with {_PREP}, t as (select note_id, regexp_extract_all(normalized_text, '{_WORD}') as w from texts)
select note_id, cast(len(w) as bigint) as n_tokens, cast(len(list_distinct(w)) as bigint) as n_distinct, sha256(array_to_string(w, ' ')) as tokens_sha from t""")
def tokenize_docs(spark, d):
    w = T.tokenize(F.col("normalized_text"))
    return _prepared(spark, d).select("note_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), F.sha2(F.array_join(w, " "), 256).alias("tokens_sha"))


@query(f"with {_PREP} select term, count(*) as frequency from (select unnest(regexp_extract_all(vocabulary_text, '{_WORD}')) as term from texts) group by 1")
def vocabulary_freq(spark, d):
    return index.vocabulary(_prepared(spark, d))


@query("select 'text' as normalized_name, 'Text' as display_name, count(distinct doc_id) as note_count from documents")
def field_name_counts(spark, d):
    return index.field_name_counts(_notes(spark, d))


@query(f"with {_PREP} select note_id, title, sha256(normalized_text) as normalized_sha, sha256(vocabulary_text) as vocabulary_sha from texts")
def prepare_notes(spark, d):
    return _prepared(spark, d).select("note_id", "title", F.sha2("normalized_text", 256).alias("normalized_sha"), F.sha2("vocabulary_text", 256).alias("vocabulary_sha"))


_CONTENT = """sha256(concat('{"decks":[', to_json(lang || '::' || source), '],"fields":[{"name":"Text","value":', to_json(coalesce(text, '')), '}],"note_id":', doc_id + 1, ',"note_type":', to_json(lang), ',"tags":[', to_json(lang), ',', to_json(source), ']}'))"""


@query(f"select doc_id + 1 as note_id, {_CONTENT} as content_hash from documents")
def content_hashes(spark, d):
    return _notes(spark, d).select("note_id", index.content_hash().alias("content_hash"))


@query("select l_orderkey as note_id, sha256(string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber)) as card_scope_hash from lineitem group by 1")
def card_scope_hash(spark, d):
    cards = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("c"))
    return cards.select("note_id", index.card_scope_hash(F.col("c")).alias("card_scope_hash"))


@query("""with a as (select doc_id, sha256(text) as c, sha256(source) as s from documents where source <> 'src4'),
b as (select doc_id, case when lang = 'de' then 'old' else sha256(text) end as c, case when source = 'src7' then 'old' else sha256(source) end as s from documents where source <> 'src3')
select coalesce(a.doc_id, b.doc_id) as note_id, case when a.doc_id is null then 'missing' when b.doc_id is null then 'insert' when a.c is distinct from b.c then 'update' when a.s is distinct from b.s then 'rescope' else 'unchanged' end as action
from a full join b on a.doc_id = b.doc_id""")
def upsert_plan(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "lang", "source", F.sha2("text", 256).alias("content_hash"), F.sha2("source", 256).alias("card_scope_hash"))
    stored = docs.where("source <> 'src3'").withColumn("content_hash", F.when(F.col("lang") == "de", "old").otherwise(F.col("content_hash"))).withColumn("card_scope_hash", F.when(F.col("source") == "src7", "old").otherwise(F.col("card_scope_hash")))
    return index.plan_upsert(docs.where("source <> 'src4'"), stored)


# --- retrieval ----------------------------------------------------------------------

_BASE = f"with {_PREP}, {_COUNTS}, {_TERMS}"


@query(f"{_BASE}, {_match('select item_id as query_id, g as group_id, term from bench where g <= 1')} {_rank('select * from m')}")
def bm25_topk_single(spark, d):
    """The longest word of each benchmark text: queries of one word are the case that is tried."""
    return _top(_scored(spark, d, _bench_terms(spark, d, 1)))


@query(f"{_BASE}, {_match('select item_id as query_id, g as group_id, term from bench where g <= 3')} {_rank('select m.* from m join wanted using (query_id) where groups = wanted')}")
def bm25_topk_and(spark, d):
    """The three longest words of each benchmark text, all required."""
    terms = _bench_terms(spark, d, 3)
    return _top(lexical.strict(_scored(spark, d, terms), terms))


@query(f"{_BASE}, {_match('select item_id as query_id, g as group_id, term from bench')} {_rank('select * from m')}")
def bm25_topk_or(spark, d):
    """All distinct words of each benchmark text, any of them."""
    return _top(_scored(spark, d, _bench_terms(spark, d)))


_PHRASE_SQL = f"""with {_PREP}, {_COUNTS},
asked as (select item_id, toks, len(toks) as size from (select item_id, regexp_extract_all({_norm("text")}, '{_TOK}') as toks from benchmark) where len(toks) >= 2),
each as (select item_id, size, unnest(toks) as term, unnest(range(size)) as i from asked),
pos as (select note_id, col, w, unnest(toks) as term, unnest(range(len(toks))) as pos from cols),
begins as (select item_id, size, note_id, col, w, pos - i as starts, count(*) as found from each join pos using (term) group by all),
hit as (select item_id, note_id, sum(w) as wf from begins where found = size group by all),
dfs as (select item_id, count(*) as df from hit group by 1),
m as (select item_id as query_id, note_id, -(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * wf * 2.2 / (wf + 1.2 * (0.25 + 0.75 * len / mean))) as score
      from hit join dfs using (item_id) join lens using (note_id), corpus)"""


@query(f"{_PHRASE_SQL} {_rank('select * from m')}")
def bm25_phrase(spark, d):
    """Each whole benchmark text as one phrase."""
    tokens = T.index_tokens(T.normalize(F.col("text")))
    asked = table(spark, d, "benchmark").select("item_id", tokens.alias("tokens")).where(F.size("tokens") >= 2)
    idx = _index(spark, d)
    clauses = asked.select(F.col("item_id").alias("query_id"), F.lit(1).alias("group_id"), F.col("item_id").alias("phrase_id"))
    return _top(lexical.matched(lexical.phrase_parts(idx.postings, asked.select(F.col("item_id").alias("phrase_id"), "tokens"), clauses, idx.terms, idx.corpus, idx.shards)))


_ALIAS_SQL = " union all ".join(f"select {i} as query_id, 1 as group_id, '{w}' as term" for i, pair in enumerate(ALIASES[:3]) for w in pair) + " union all select unnest([0, 1, 2]), 2, 'the'"


@query(f"with {_PREP}, {_COUNTS}, {_match(_ALIAS_SQL)} {_rank('select m.* from m join wanted using (query_id) where groups = wanted')}")
def alias_group_match(spark, d):
    rows = [(i, 1, w) for i, pair in enumerate(ALIASES[:3]) for w in pair] + [(i, 2, "the") for i in range(3)]
    terms = spark.createDataFrame(rows, "query_id int, group_id int, term string")
    return _top(lexical.strict(_scored(spark, d, terms), terms))


_FUSED = f"""{_BASE}, {_match("select item_id as query_id, g as group_id, term from bench where g <= 3")},
s as (select query_id, note_id, 4.0 as w, rank from ({_rank("select m.* from m join wanted using (query_id) where groups = wanted", 250)})),
b as (select query_id, note_id, 1.0 as w, rank from ({_rank("select * from m", 300)})),
fused as (select query_id, note_id, round(sum(w / (60.0 + rank)), 8) as score from (select * from s union all select * from b) group by all),
placed as (select *, row_number() over (partition by query_id order by score desc, note_id) as position from fused)"""


def _fused(spark, d):
    terms = _bench_terms(spark, d, 3)
    matches = _scored(spark, d, terms)
    strict = lexical.ranked(lexical.strict(matches, terms), fusion.source_limit("literal_strict", TOP), [F.round("score", 9)])
    broad = lexical.ranked(matches, fusion.source_limit("literal_broad", TOP), [F.round("score", 9)])
    hits = strict.select("query_id", "note_id", F.lit("literal_strict").alias("source"), "rank").unionByName(broad.select("query_id", "note_id", F.lit("literal_broad").alias("source"), "rank"))
    return fusion.reciprocal_ranks(hits).withColumn("score", F.round("score", 8))


def _placed(fused: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id")
    return fused.withColumn("position", F.row_number().over(w).cast("bigint"))


@query(f"{_FUSED} select query_id, note_id, score, position from placed where position <= {TOP}")
def rrf_fusion(spark, d):
    return _placed(_fused(spark, d)).where(F.col("position") <= TOP).select("query_id", "note_id", "score", "position")


@query(f"{_FUSED} select query_id, note_id, score, position from placed where note_id in (select doc_id + 1 from documents where lang = 'en' and source in ('src1', 'src2'))")
def eligibility_mask(spark, d):
    """Positions are of the whole corpus: the mask leaves gaps and renumbers nothing."""
    allowed = _notes(spark, d).where(compile_filter("note:en (tag:src1 OR tag:src2)")).select("note_id")
    return fusion.masked(_placed(_fused(spark, d)), allowed).select("query_id", "note_id", "score", "position")


@query(f"""{_FUSED}, toks as (select note_id, list_distinct(regexp_extract_all(normalized_text, '{_WORD}')) as w from texts),
cov as (select query_id, note_id, score, (select count(*) from asked a where a.query_id = f.query_id and list_contains(t.w, a.term)) as matched, note_id in (select note_id from s where s.query_id = f.query_id) as safe from fused f join toks t using (note_id)),
best as (select query_id, max(matched) as best from cov group by 1)
select query_id, note_id, score, matched from cov join best using (query_id) where safe or matched >= case when best >= 4 then best - 1 else best end""")
def concept_coverage_cutoff(spark, d):
    terms = _bench_terms(spark, d, 3)
    concepts = terms.groupBy("query_id").agg(F.collect_list(F.array(F.struct(F.col("term").alias("text"), F.lit(False).alias("phrase")))).alias("concepts"))
    docs = _index(spark, d).prepared.select("note_id", "normalized_text", T.tokenize(F.col("normalized_text")).alias("tokens"))
    rows = fusion.coverage(_fused(spark, d).join(concepts, "query_id").join(docs, "note_id"))
    return fusion.smart_cutoff(rows).select("query_id", "note_id", "score", F.col("matched").cast("bigint").alias("matched"))


@query()
def smart_search(spark, d):
    return _engine(spark, d).search(SMART_QUERIES, field_names=["Text"])


@query()
def exact_engine_search(spark, d):
    return _engine(spark, d).search(SMART_QUERIES, mode="exact", field_names=["Text"])


#: Queries of words and of a quoted phrase for the whole chain of exact mode.
EXACT_QUERIES = ["stupid idiot", "the thing", '"of the"']
_EXACT_WORDS = "(values (0, 0, 'stupid'), (0, 1, 'idiot'), (1, 0, 'the'), (1, 1, 'thing'))"
_EXACT_SQL = rf"""with {_PREP}, {_COUNTS}, {_match(f"select * from {_EXACT_WORDS} as t(query_id, group_id, term)")},
ranked as (select query_id, note_id, 1.0 as w, row_number() over (partition by query_id order by score, note_id) as r, 300 as most from m
  union all select query_id, note_id, 4.0, row_number() over (partition by query_id order by score, note_id), 250 from m join wanted using (query_id) where groups = wanted),
pos as (select note_id, col, w, unnest(toks) as term, unnest(range(len(toks))) as i from cols),
hit as (select x.note_id, sum(x.w) as wf from pos x join pos y on x.term = 'of' and y.term = 'the' and y.note_id = x.note_id and y.col = x.col and y.i = x.i + 1 group by all),
ph as (select note_id, -(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end * wf * 2.2 / (wf + 1.2 * (0.25 + 0.75 * len / mean))) as score
       from hit join lens using (note_id), corpus, (select count(*) as df from hit)),
every as (select * from ranked union all select 2, note_id, 4.0, row_number() over (order by score, note_id), 250 from ph),
fused as (select query_id, note_id, sum(w / (60.0 + r)) as score from every where r <= most group by all),
words as (select note_id, normalized_text, regexp_extract_all(normalized_text, '{_WORD}') as toks, regexp_extract_all(lower(title), '{_WORD}') as title_toks from texts),
asked_words as (select 0 as query_id, 'stupid' as a, 'idiot' as b, null as phrase union all select 1, 'the', 'thing', null union all select 2, 'of', 'the', 'of the'),
places as (select note_id, unnest(toks) as term, unnest(range(len(toks))) as i from words where note_id in (select note_id from fused)),
near as (select query_id, x.note_id, min(abs(x.i - y.i)) + 1 as span from asked_words q join places x on x.term = q.a join places y on y.term = q.b and y.note_id = x.note_id group by all),
boosted as (select f.query_id, f.note_id, f.score + case when phrase is not null and contains(normalized_text, phrase) then 0.055 else 0 end + case when span is not null then 0.035 + 0.018 / greatest(1.0, log2(span + 1)) else 0 end
    + case when list_contains(title_toks, a) and list_contains(title_toks, b) then 0.02 else 0 end as score
  from fused f join asked_words q using (query_id) join words using (note_id) left join near using (query_id, note_id)),
placed as (select *, row_number() over (partition by query_id order by round(score, 9) desc, note_id) as position, count(*) over (partition by query_id) as total_candidates from boosted)
select query_id, note_id, cast(position as integer) as position, round(score, 8) as score, cast(total_candidates as bigint) as total_candidates from placed where position <= {TOP}"""


@query(_EXACT_SQL)
def exact_search_scores(spark, d):
    """Sources, fusion, phrase, all-terms, proximity and title boosts, order and limit of exact mode."""
    found = _engine(spark, d).search(EXACT_QUERIES, mode="exact", limit=TOP, field_names=["Text"])
    return found.select("query_id", "note_id", "position", "score", "total_candidates")


def _engine(spark, d) -> Engine:
    return Engine(spark, _index(spark, d))


@query(f"""with {_PREP} select note_id, title, cast(null as double) as score from texts join documents on doc_id + 1 = note_id
where documents.lang = 'en' and (contains(lower(text), 'stupid') or contains(lower(text), 'moron')) and not contains(lower(text), 'clown') order by note_id limit {TOP}""")
def native_search(spark, d):
    return _engine(spark, d).exact("deck:en (stupid OR moron) -clown", TOP)


@query(f"""with {_PREP}, t as (select note_id, normalized_text, regexp_extract_all(normalized_text, '{_WORD}') as w from texts)
select note_id from t where list_contains(w, 'stupid') and not (list_contains(w, 'clown') or contains(normalized_text, 'of the'))""")
def negative_terms(spark, d):
    rows = _prepared(spark, d).withColumn("tokens", T.tokenize(F.col("normalized_text")))
    negatives = F.array(F.struct(F.lit("clown").alias("text"), F.lit(False).alias("phrase")), F.struct(F.lit("of the").alias("text"), F.lit(True).alias("phrase")))
    return rows.where(F.array_contains("tokens", "stupid") & ~fusion.contains_negative(F.col("normalized_text"), F.col("tokens"), negatives)).select("note_id")


@query(f"select doc_id + 1 as note_id, 1.0::double as score from documents where lang = 'fr' and source <> 'src2' order by doc_id limit {TOP}")
def filter_only(spark, d):
    found = _notes(spark, d).where(compile_filter("deck:fr -tag:src2")).orderBy("note_id").limit(TOP)
    return found.select("note_id", F.lit(1.0).alias("score"))


@query(f"""with {_PREP}, t as (select note_id, regexp_extract_all(normalized_text, '{_WORD}') as w from texts),
pos as (select note_id, unnest(w) as term, unnest(range(len(w))) as i from t),
ev as (select *, sum(cast(term = 'the' as integer)) over (partition by note_id order by i) as the_n, min(case when term = 'of' then i end) over (partition by note_id order by i rows between current row and unbounded following) as next_of from pos where term in ('the', 'of')),
second as (select note_id, the_n, min(i) as i from ev where term = 'the' group by all)
select e.note_id, cast(min(greatest(s.i, next_of) - e.i + 1) as integer) as span from ev e join second s on s.note_id = e.note_id and s.the_n = e.the_n + case when e.term = 'the' then 1 else 2 end where next_of is not null group by 1""")
def proximity_span(spark, d):
    docs = _prepared(spark, d).select("note_id", T.tokenize(F.col("normalized_text")).alias("tokens"))
    wanted = F.array(F.lit("the"), F.lit("of"), F.lit("the"))
    return docs.select("note_id", fusion.cover_span_column(F.col("tokens"), wanted).alias("span")).where("span is not null")


# --- spelling and aliases -----------------------------------------------------------

_MASK = "list_reduce(list_transform(string_split({x}, ''), lambda c: cast(1 as ubigint) << (unicode(c) % 64)), lambda a, b: a | b)"
_VOCAB = f"vocab as (select term, count(*) as frequency from (select unnest(regexp_extract_all(vocabulary_text, '{_WORD}')) as term from texts) group by 1)"
_ASKED = "asked as (select token, case when length(token) <= 3 then 0 when length(token) <= 5 then 1 else 2 end as budget from (select unnest([" + ", ".join(f"'{w}'" for w in MISSPELLED) + "]) as token))"
_SUGGEST = f"""with {_PREP}, {_VOCAB}, {_ASKED},
near as (select token, term, frequency, damerau_levenshtein(token, term) as distance, coalesce((select v.frequency from vocab v where v.term = token), 0) as own from asked, vocab where term <> token and abs(length(term) - length(token)) <= budget and damerau_levenshtein(token, term) <= budget),
conf as (select *, least(0.999, 1 - distance / greatest(length(token), length(term)) + least(0.035, log10(frequency + 1) * 0.008)) as confidence from near where own <= 1),
sug as (select *, row_number() over (partition by token order by distance, confidence desc, frequency desc, term) as rank from conf)"""


def _vocab(spark, d):
    return fuzzy.build_vocabulary(_index(spark, d).words)


def _asked(spark):
    return spark.createDataFrame([(w,) for w in MISSPELLED], "token string")


@query(f"""with {_PREP}, {_VOCAB}, {_ASKED} select token, term, cast(budget as bigint) as budget from asked, vocab where budget > 0 and term <> token and abs(length(term) - length(token)) <= budget
and bit_count(xor({_MASK.format(x="token")}, {_MASK.format(x="term")})) <= 2 * budget""")
def fuzzy_candidates(spark, d):
    return fuzzy.candidates(_asked(spark), _vocab(spark, d)).select("token", "term", F.col("budget").cast("bigint").alias("budget"))


@query(f"{_SUGGEST} select token, rank, term, cast(distance as bigint) as distance, round(confidence, 6) as confidence, frequency from sug where rank <= 5")
def fuzzy_suggestions(spark, d):
    found = fuzzy.suggestions(_asked(spark), _vocab(spark, d))
    return found.select("token", F.col("rank").cast("bigint").alias("rank"), "term", F.col("distance").cast("bigint").alias("distance"), F.round("confidence", 6).alias("confidence"), "frequency")


@query(f"""{_SUGGEST}, p as (select a.*, b.distance as d2, b.confidence as c2, b.frequency as f2 from sug a left join sug b on a.token = b.token and b.rank = 2 where a.rank = 1),
g as (select *, case when d2 = distance then confidence - c2 else 1.0 end as margin from p)
select token, term as corrected, cast(distance as bigint) as distance, round(confidence, 6) as confidence,
own = 0 and ((distance = 1 and length(token) >= 6 and (margin >= 0.012 or frequency >= coalesce(f2 * 5, 1))) or (distance = 2 and length(token) >= 9 and confidence >= 0.84 and margin >= 0.02)) as automatic from g""")
def fuzzy_corrections(spark, d):
    found = fuzzy.corrections(fuzzy.suggestions(_asked(spark), _vocab(spark, d)))
    return found.select("token", "corrected", F.col("distance").cast("bigint").alias("distance"), F.round("confidence", 6).alias("confidence"), "automatic")


_ALIAS_ROWS = "(values " + ", ".join(f"('{a}', '{c}')" for a, c in ALIASES) + ") as t(alias, canonical)"


@query(f"""with a as (select * from {_ALIAS_ROWS}), v as (select unnest(['loser', 'idiot', 'plan b', 'none']) as value)
select value, canonical as expanded, 'alias_to_canonical' as direction from v join a on value = alias
union select value, alias, 'canonical_to_alias' from v join a on value = canonical where not contains(alias, ' ')""")
def alias_expand(spark, d):
    values = spark.createDataFrame([("loser",), ("idiot",), ("plan b",), ("none",)], "value string")
    return fuzzy.expand_aliases(values, spark.createDataFrame(ALIASES, "alias string, canonical string"))


@query("""with items as (select distinct o_orderpriority as alias, o_orderstatus as item, cast(year(o_orderdate) as varchar) as ingredient from orders),
sets as (select alias, item, list_sort(list(ingredient)) as s from items group by all), u as (select distinct alias, s from sets),
n as (select alias, count(*) as n from u group by 1), k as (select alias, ingredient, count(*) as k from (select alias, unnest(s) as ingredient from u) group by all)
select alias, alias as surface, ingredient from k join n using (alias) where k = n""")
def alias_etl_intersection(spark, d):
    o = table(spark, d, "orders")
    return fuzzy.shared_ingredients(o.select(F.col("o_orderpriority").alias("alias"), F.col("o_orderpriority").alias("surface"), F.col("o_orderstatus").alias("item"), F.year("o_orderdate").cast("string").alias("ingredient")))


# --- vectors ------------------------------------------------------------------------

_SIM = "sim as (select e.vec_id as note_id, e.label, round(list_cosine_similarity(cast(e.embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)), 6) as similarity from embeddings e)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding", "label")


def _first_vector(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first().embedding)


def _similar(spark, d, k=None, allowed=None):
    v = _vectors(spark, d)
    if k is None:
        q = F.broadcast(v.where("note_id = 0").select(F.col("embedding").alias("q")))
        sim = vectors.dot(F.col("embedding"), F.col("q")) / (vectors.norm(F.col("embedding")) * vectors.norm(F.col("q")))
        return v.join(q, F.lit(True)).select("note_id", F.round(sim, 6).alias("similarity"))
    return vectors.topk(v, _first_vector(spark, d), k, allowed).withColumn("similarity", F.round("similarity", 6))


@query(f"with {_SIM} select note_id, similarity from sim order by similarity desc, note_id limit {TOP}")
def vector_topk(spark, d):
    return _similar(spark, d, TOP)


@query(f"with {_SIM} select note_id, similarity from sim where label in (2, 5) order by similarity desc, note_id limit {TOP}")
def vector_topk_filtered(spark, d):
    return _similar(spark, d, TOP, _vectors(spark, d).where("label in (2, 5)"))


@query("""with s as (select q.vec_id as query_id, e.vec_id as note_id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as sim from embeddings q, embeddings e where q.label = 3),
r as (select *, row_number() over (partition by query_id order by sim desc, note_id) as rank from s)
select query_id, note_id, round(sim, 6) as similarity, cast(rank as integer) as rank from r where rank <= 10""")
def vector_topk_batch(spark, d):
    v = _vectors(spark, d)
    return vectors.topk_batch(v, v.where("label = 3").select(F.col("note_id").alias("query_id"), "embedding"), 10).withColumn("similarity", F.round("similarity", 6))


@query("""select doc_id as note_id, sha256(text) as text_hash from documents left join (select vec_id, case when label = 0 then 'old' else (select sha256(text) from documents d where d.doc_id = vec_id) end as known from embeddings) e on vec_id = doc_id where sha256(text) is distinct from known""")
def vector_stale(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), T.text_hash(F.col("text")).alias("text_hash"))
    stored = _vectors(spark, d).join(docs, "note_id", "left").select("note_id", F.when(F.col("label") == 0, "old").otherwise(F.col("text_hash")).alias("content_hash"))
    return vectors.stale(docs, stored)


@query("select vec_id as note_id from embeddings where vec_id not in (select doc_id from documents where lang = 'en')")
def vector_orphans(spark, d):
    return vectors.orphans(_vectors(spark, d), table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("note_id")))


@query(f"with {_SIM}, r as (select *, row_number() over (order by similarity desc, note_id) as rank from sim) select note_id, rank, similarity, round(1.35 / (60.0 + rank) + greatest(0, least(1, similarity)) * 0.006, 8) as score from r where rank <= 150")
def hybrid_vector_fusion(spark, d):
    hits = _similar(spark, d, max(100, 3 * TOP)).withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "note_id")))
    return fusion.semantic_scores(hits).select("note_id", F.col("rank").cast("bigint").alias("rank"), "similarity", F.round("score", 8).alias("score"))


@query(f"with {_SIM}, t as (select median(similarity) as mid, max(similarity) as top from sim) select note_id, similarity from sim, t where similarity >= mid + 0.30 * (top - mid)")
def semantic_cutoff(spark, d):
    return fusion.semantic_cutoff(_similar(spark, d).withColumn("query_id", F.lit(0))).select("note_id", "similarity")


# --- related, scopes ----------------------------------------------------------------


@query("""with tags as (select doc_id + 1 as note_id, lang, lower(source) as tag_key from documents),
f as (select tag_key, count(*) as frequency from tags where tag_key in (select tag_key from tags where lang = 'es') group by 1)
select note_id, count(*) as shared, min(frequency) as least, cast(sum(frequency) as bigint) as total, round(count(*) + sum(1.0 / frequency), 8) as score
from tags join f using (tag_key) where lang <> 'es' group by 1""")
def related_docs(spark, d):
    notes = _notes(spark, d).withColumn("tags", F.array(F.element_at("tags", 2)))
    tags = related.source_tags(notes, providers=("src",))
    seeds = notes.where("note_type = 'es'").select("note_id")
    return related.related(tags, seeds).withColumn("score", F.round("score", 8))


@query("""with d as (select distinct lang || '::' || source as name from documents union select distinct lang from documents), h as (select name from d where contains(lower(name), 'src1'))
select name from d where name in (select name from h) or name in (select split_part(name, '::', 1) from h)""")
def deck_tree_filter(spark, d):
    docs = table(spark, d, "documents")
    names = docs.select(F.concat_ws("::", "lang", "source").alias("name")).union(docs.select("lang")).distinct()
    return visible_decks(names, "SRC1")


@query("select doc_id + 1 as note_id from documents where lang = 'fr' or (lang = 'en' and source <> 'src1')")
def deck_scope(spark, d):
    scope = Scope.of(["en", "fr", "en::src3"], ["en::src1"])
    return _notes(spark, d).where(F.exists("decks", scope.column)).select("note_id")


@query("select doc_id + 1 as note_id, concat('Tags: ', lang, ', ', source) as tags, source as deck from documents")
def tag_summary(spark, d):
    return _notes(spark, d).select("note_id", T.tag_summary(F.col("tags")).alias("tags"), T.deck_label(F.element_at("decks", 1)).alias("deck"))


# --- change capture -----------------------------------------------------------------

_SAVED_ORDERS = "select o_orderkey, o_custkey, case when o_orderpriority = '1-URGENT' then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderstatus from orders where o_orderstatus <> 'P' union all select -1 - o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders where o_orderpriority = '2-HIGH'"


@query(f"""with b as ({_SAVED_ORDERS}) select coalesce(a.o_orderkey, b.o_orderkey) as note_id,
case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'deleted' when a.o_custkey is distinct from b.o_custkey or a.o_totalprice is distinct from b.o_totalprice or a.o_orderstatus is distinct from b.o_orderstatus then 'changed' else 'unchanged' end as change
from orders a full join b on a.o_orderkey = b.o_orderkey""")
def note_manifest_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    saved = o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    saved = saved.unionByName(o.where("o_orderpriority = '2-HIGH'").withColumn("note_id", -1 - F.col("note_id")))
    return changes.note_diff(o, saved, ("o_custkey", "o_totalprice", "o_orderstatus"), ())


_CARDS = "select l_orderkey * 1000 + l_linenumber as card_id, min(l_orderkey) + 1 as note_id, min(l_suppkey) + 1 as home_deck_id from lineitem group by 1"
_SAVED_CARDS = "select card_id, case when home_deck_id < 20 then note_id + 1 else note_id end as note_id, case when home_deck_id between 20 and 40 then home_deck_id + 1 else home_deck_id end as home_deck_id from cards where home_deck_id <> 50 union all select -card_id - 1, note_id, home_deck_id from cards where home_deck_id = 60"
_CARD_DIFF = f"""with cards as ({_CARDS}), saved as ({_SAVED_CARDS}),
d as (select coalesce(a.card_id, b.card_id) as card_id, case when b.card_id is null then 'added' when a.card_id is null then 'deleted' when a.note_id is distinct from b.note_id or a.home_deck_id is distinct from b.home_deck_id then 'changed' else 'unchanged' end as change, a.note_id as new_note_id, b.note_id as old_note_id from cards a full join saved b on a.card_id = b.card_id)"""


def _card_diff(spark, d):
    cards = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("card_id")).agg((F.min("l_orderkey") + 1).alias("note_id"), (F.min("l_suppkey") + 1).alias("home_deck_id"))
    deck = F.col("home_deck_id")
    saved = cards.where(deck != 50).select("card_id", F.when(deck < 20, F.col("note_id") + 1).otherwise(F.col("note_id")).alias("note_id"), F.when(deck.between(20, 40), deck + 1).otherwise(deck).alias("home_deck_id"))
    saved = saved.unionByName(cards.where(deck == 60).withColumn("card_id", -F.col("card_id") - 1))
    return changes.card_diff(cards, saved)


@query(f"{_CARD_DIFF} select card_id, change from d")
def card_manifest_diff(spark, d):
    return _card_diff(spark, d).select("card_id", "change")


@query(f"{_CARD_DIFF} select distinct note_id from (select new_note_id as note_id from d where change <> 'unchanged' union all select old_note_id from d where change <> 'unchanged') where note_id > 0")
def affected_owners(spark, d):
    return changes.affected_owners(_card_diff(spark, d))


_FACETS = """with cur as (select 'nation' as facet, n_nationkey + 1 as object_id, n_name as signature from nation union all select 'region', r_regionkey + 1, r_name from region),
sav as (select facet, object_id, case when facet = 'nation' and object_id in (3, 7) then signature || '*' else signature end as signature from cur where not (facet = 'region' and object_id = 2)),
d as (select coalesce(a.facet, b.facet) as facet, coalesce(a.object_id, b.object_id) as object_id, case when b.facet is null then 'added' when a.facet is null then 'deleted' when a.signature is distinct from b.signature then 'changed' else 'unchanged' end as change from cur a full join sav b on a.facet = b.facet and a.object_id = b.object_id)"""


def _facet_diff(spark, d):
    cur = table(spark, d, "nation").select(F.lit(" Nation ").alias("facet"), (F.col("n_nationkey") + 1).cast("bigint").alias("object_id"), F.col("n_name").alias("signature")).unionByName(table(spark, d, "region").select(F.lit("region").alias("facet"), (F.col("r_regionkey") + 1).cast("bigint").alias("object_id"), F.col("r_name").alias("signature")))
    sav = cur.where("not (facet = 'region' and object_id = 2)").withColumn("signature", F.when((F.trim("facet") == "Nation") & F.col("object_id").isin(3, 7), F.concat("signature", F.lit("*"))).otherwise(F.col("signature")))
    return changes.facet_diff(cur, sav)


@query(f"{_FACETS} select facet, cast(object_id as bigint) as object_id, change from d")
def facet_manifest_diff(spark, d):
    return _facet_diff(spark, d).select("facet", "object_id", "change")


@query(f"{_FACETS} select distinct c_custkey as note_id from customer where c_nationkey + 1 in (select object_id from d where facet = 'nation' and change <> 'unchanged')")
def facet_fanout(spark, d):
    members = table(spark, d, "customer").select(F.lit("nation").alias("facet"), (F.col("c_nationkey") + 1).cast("bigint").alias("object_id"), F.col("c_custkey").alias("note_id"))
    return changes.fan_out(_facet_diff(spark, d), members)


@query("select count(*) as n_notes, max(o_orderkey) as last_note, cast(sum(o_custkey) as bigint) as owners, (select count(*) from lineitem) as n_cards, (select cast(sum(l_suppkey) as bigint) from lineitem) as decks, sha256(concat_ws('|', count(*), max(o_orderkey), cast(sum(o_custkey) as bigint), (select count(*) from lineitem), (select cast(sum(l_suppkey) as bigint) from lineitem))) as fingerprint from orders")
def collection_fingerprint(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("n_notes"), F.max("o_orderkey").alias("last_note"), F.sum("o_custkey").alias("owners"))
    c = table(spark, d, "lineitem").agg(F.count("*").alias("n_cards"), F.sum("l_suppkey").alias("decks"))
    both = o.join(c, F.lit(True))
    return both.withColumn("fingerprint", F.sha2(F.concat_ws("|", *both.columns), 256))


_REASON = "case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 4 when 'purchase' then 8 else 16 end"
_QUEUE = f"q as (select user_id + 1 as note_id, bit_or({_REASON}) as reasons, max(event_id) as sequence, cast(0 as bigint) as attempts from events where user_id + 1 > 0 group by 1)"


def _feed(spark, d):
    reason = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 4).when(F.col("event_type") == "purchase", 8).otherwise(16)
    return table(spark, d, "events").select((F.col("user_id") + 1).alias("note_id"), reason.alias("reasons"), F.col("event_id").alias("sequence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("queued_at"), "event_type")


def _queue(spark, d):
    return changes.coalesce_queue(_feed(spark, d))


def _shown(queue: DataFrame) -> DataFrame:
    return queue.select("note_id", F.col("reasons").cast("bigint").alias("reasons"), "sequence", F.col("attempts").cast("bigint").alias("attempts"))


@query(f"with {_QUEUE} select note_id, cast(reasons as bigint) as reasons, sequence, attempts from q")
def dirty_queue_coalesce(spark, d):
    return _shown(_queue(spark, d))


_ACK = f"ack as (select user_id + 1 as note_id, event_id as sequence, {_REASON} as r from events where event_type in ('view', 'purchase'))"


@query(f"with {_QUEUE}, {_ACK} select note_id, cast(reasons & ~coalesce(r, 0) as bigint) as reasons, sequence, attempts from q left join ack using (note_id, sequence) where reasons & ~coalesce(r, 0) <> 0")
def dirty_queue_ack(spark, d):
    done = _feed(spark, d).where("event_type in ('view', 'purchase')").select("note_id", "sequence", "reasons")
    return _shown(changes.acknowledge(_queue(spark, d), done))


@query(f"with {_QUEUE} select note_id, sequence, row_number() over (order by sequence, note_id) as position from q order by sequence, note_id limit {TOP}")
def dirty_queue_pending(spark, d):
    first = changes.pending(_queue(spark, d), TOP)
    return first.select("note_id", "sequence", F.row_number().over(Window.orderBy("sequence", "note_id")).cast("bigint").alias("position"))


@query("select user_id as note_id, max(event_id) as sequence, case when arg_max(event_type, event_id) = 'error' then 'delete' else 'upsert' end as action from events group by 1")
def delta_last_wins(spark, d):
    return changes.last_wins(table(spark, d, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("sequence"), (F.col("event_type") == "error").alias("deleted")))


# --- cards and actions --------------------------------------------------------------

_CARD_SQL = """cards as (select l_orderkey * 1000 + l_linenumber as card_id, min(l_orderkey) as note_id, min(l_suppkey) as did, max(case when l_returnflag = 'R' then l_partkey else 0 end) as odid,
cast(min(l_quantity) as bigint) as flags, min(case l_linestatus when 'F' then -1 else case l_returnflag when 'A' then -2 else 0 end end) as queue from lineitem group by 1),
state as (select card_id, note_id, case when odid > 0 then odid when did > 0 then did else 0 end as home_deck_id, flags & 7 as flag, queue = -1 as suspended, queue in (-2, -3) as buried from cards)"""


def _card_rows(spark, d):
    queue = F.when(F.col("l_linestatus") == "F", -1).when(F.col("l_returnflag") == "A", -2).otherwise(0)
    rows = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("card_id")).agg(
        F.min("l_orderkey").alias("note_id"), F.min("l_suppkey").alias("did"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).otherwise(0)).alias("odid"),
        F.min("l_quantity").cast("bigint").alias("flags"), F.min(queue).alias("queue"),
    )
    return rows.select("card_id", "note_id", home_deck(F.col("did"), F.col("odid")).alias("home_deck_id"), card_state(F.col("flags"), F.col("queue")).alias("s")).select("card_id", "note_id", "home_deck_id", "s.*")


@query("select l_orderkey as note_id, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) as card_ids from lineitem group by 1")
def cards_by_note(spark, d):
    from quern.sources.notes import cards_by_note as grouped

    cards = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("nid"))
    return grouped(cards).select(F.col("nid").alias("note_id"), F.concat_ws(",", F.transform("card_ids", lambda c: c.cast("string"))).alias("card_ids"))


@query(f"with {_CARD_SQL} select card_id, note_id, cast(home_deck_id as bigint) as home_deck_id from state")
def home_decks(spark, d):
    return _card_rows(spark, d).select("card_id", "note_id", "home_deck_id")


@query(f"with {_CARD_SQL} select card_id, cast(flag as bigint) as flag, suspended, buried from state")
def live_card_state(spark, d):
    return _card_rows(spark, d).select("card_id", F.col("flag").cast("bigint").alias("flag"), "suspended", "buried")


_ACTION_KINDS = {"flag": "flag <> 3", "suspend": "not suspended", "unsuspend": "suspended", "bury": "not buried and not suspended", "unbury": "buried", "change_deck": "home_deck_id <> 5"}


@query(f"with {_CARD_SQL}, asked as (select card_id from cards union select -card_id + 100000000000 from cards where card_id < 50000) " + " union all ".join(f"select '{k}' as kind, count(*) as requested, count(s.card_id) as live, count(*) filter ({e}) as eligible, count(*) - count(s.card_id) as stale, count(*) filter (s.card_id is not null and not ({e})) as skipped, count(distinct case when ({e}) and note_id > 0 then note_id end) as note_count from asked a left join state s on a.card_id = s.card_id" for k, e in _ACTION_KINDS.items()))
def action_plan_counts(spark, d):
    cards = _card_rows(spark, d)
    asked = cards.select("card_id").union(cards.where("card_id < 50000").select(-F.col("card_id") + 100000000000)).distinct()
    out = None
    for kind in _ACTION_KINDS:
        a = actions.Action(kind, flag=3 if kind == "flag" else None, deck_id=5 if kind == "change_deck" else None)
        row = actions.counts(actions.classify(asked, cards, a)).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {_CARD_SQL} select home_deck_id, count(distinct note_id) as notes, count(distinct card_id) as cards from state group by 1")
def selection_counts(spark, d):
    return _card_rows(spark, d).groupBy("home_deck_id").agg(F.countDistinct("note_id").alias("notes"), F.countDistinct("card_id").alias("cards"))


@query(f"with {_CARD_SQL} select note_id, count(*) as total, count(*) filter (suspended) as suspended, count(*) filter (buried) as buried, count(*) filter (flag = 0) as unflagged, count(*) filter (flag = 1) as red from state group by 1")
def card_state_summary(spark, d):
    return actions.state_counts(_card_rows(spark, d), "note_id").select("note_id", "total", "suspended", "buried", F.col("flag_0").alias("unflagged"), F.col("flag_1").alias("red"))


# --- display, parsing (golden tests stand for an oracle) ------------------------------


_BLOCKS = "|".join(sorted(T.BLOCK_TAGS, key=len, reverse=True))
_BARE_HTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style|svg)[^>]*>.*?</(script|style|svg)>', '', 'gs'), '</?({_BLOCKS})(\s[^>]*)?/?>', ' ', 'g'), '</?[a-zA-Z!][^>]*>', '', 'g')"


@query(rf"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace({_BARE_HTML}, '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


@query(f"with {_PREP} select note_id, cast(len(string_split({_norm('plain')}, 'the')) - 1 as integer) as n_spans, cast(3 * (len(string_split({_norm('plain')}, 'the')) - 1) as bigint) as covered from prep")
def normalized_spans(spark, d):
    """Occurrences of a needle and the source characters they cover; ``find_spans`` gives their places."""
    spans = T.merge_spans(T.clamp_spans(T.find_spans(F.col("plain_text"), F.lit("the")), F.col("plain_text")))
    found = _index(spark, d).prepared.select("note_id", T.find_spans(F.col("plain_text"), F.lit("the")).alias("found"), spans.alias("merged"))
    return found.select("note_id", F.size("found").alias("n_spans"), F.aggregate("merged", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("covered"))


_BARE = "lower(strip_accents(plain))"


@query(f"""with {_PREP}, h as (select note_id, plain, length(plain) as n, strpos({_BARE}, 'stupid') as a, strpos({_BARE}, 'moron') as b from prep),
f as (select *, case when a > 0 and (b = 0 or a < b) then a - 1 when b > 0 then b - 1 end as first, case when a > 0 and (b = 0 or a < b) then 6 else 5 end as size from h),
c as (select *, greatest(0, first - 90) as low0, least(n, first + size + 90) as high0 from f),
l as (select *, case when low0 > 0 and strpos(substr(plain, low0 + 1, first - low0), ' ') > 0 then low0 + strpos(substr(plain, low0 + 1, first - low0), ' ') else low0 end as low,
        case when high0 < n and strpos(substr(reverse(substr(plain, first + size + 1, high0 - first - size)), 1), ' ') > 0 then high0 - strpos(reverse(substr(plain, first + size + 1, high0 - first - size)), ' ') else high0 end as high from c)
select note_id, case when first is null then case when n <= 240 then plain else rtrim(substr(plain, 1, 239)) || '…' end
  else case when low > 0 then '…' else '' end || trim(substr(plain, low + 1, high - low)) || case when high < n then '…' else '' end end as snippet from l""")
def snippets(spark, d):
    return _index(spark, d).prepared.select("note_id", T.snippet(F.col("plain_text"), F.array(F.lit("stupid"), F.lit("moron"))).alias("snippet"))


@query(f"with {_PREP} select note_id, case when plain = '' then 'Note ' || note_id when length(plain) <= 220 then plain else rtrim(substr(plain, 1, 219)) || '…' end as \"primary\", '' as support from prep")
def display_lines(spark, d):
    return _index(spark, d).prepared.select("note_id", T.display_lines(F.col("plain_fields"), F.array(F.lit("stupid")), F.col("note_id")).alias("l")).select("note_id", "l.primary", "l.support")


_HITS = "cast(len(string_split({t}, '{w}')) - 1 as bigint)"


@query(f"with {_PREP}, t as (select note_id, {_norm('title')} as t from prep) select note_id, {_HITS.format(t='t', w='the')} as literal, {_HITS.format(t='t', w='of')} as correction, {_HITS.format(t='t', w='thing')} as alias from t")
def highlight(spark, d):
    """Highlighted spans of titles, by kind; these terms cannot overlap, so none hides another."""
    spans = T.highlight(F.col("title"), F.array(F.lit("the")), F.array(F.lit("of")), F.array(F.lit("thing")))
    kinds = _index(spark, d).prepared.select("note_id", spans.alias("s")).select("note_id", F.transform("s", lambda s: s["kind"]).alias("k"))
    count = lambda kind: F.size(F.filter("k", lambda x: x == kind)).cast("bigint").alias(kind)
    return kinds.select("note_id", *map(count, ("literal", "correction", "alias")))


#: Queries, and what must be read from them: terms, filters, the filters' expression, exact only.
PARSED = [
    ("stupid idiot", "stupid,idiot", "", "", False), ('"the" moron', "the,moron", "", "", False), ("trash -clown", "trash,-clown", "", "", False),
    ("deck:en pathetic", "pathetic", "deck:en", "deck:en", False), ("tag:src1 OR moron", "tag:src1,moron", "", "", True), ("is: word (", "word", "is:", "is:", False),
    ("(deck:A OR tag:b) AND x", "x", "deck:A,tag:b", "(deck:A OR tag:b)", False), ("snake_case", "snake_case", "", "", True), ("Text:a b", "b", "Text:a", "Text:a", False),
]
_PARSED_SQL = ", ".join("(" + ", ".join("true" if v is True else "false" if v is False else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in PARSED)


@query(f"select * from (values {_PARSED_SQL}) as t(query, terms, filters, filter_query, exact_only)")
def parse_queries(spark, d):
    """Fixed query texts; the SQL holds what must be read from them."""
    parser, rows = Parser(field_names=["Text"]), []
    for text, *_ in PARSED:
        p = parser.parse(text)
        rows.append((text, ",".join("-" * t.negated + t.normalized for t in p.terms), ",".join(p.filters), p.filter_query, p.exact_only))
    return spark.createDataFrame(rows, "query string, terms string, filters string, filter_query string, exact_only boolean")


