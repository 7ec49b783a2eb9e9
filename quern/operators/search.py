"""Hybrid search over an index, many queries in one plan.

Query texts are parsed on the driver (they are few and tiny); everything that touches
notes is a DataFrame. Modes: smart (lexical, corrections, aliases, coverage cutoff),
exact (lexical only), semantic (vectors, distribution cutoff). A query whose Boolean
structure ranking would lose is evaluated as a predicate, whatever the mode.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import regex
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.joins import join_small
from quern.functions.text import INDEX_TOKEN, display_lines, normal, tokenize, words
from quern.operators import fusion, fuzzy, index, lexical
from quern.operators.versions import Versions
from quern.plans.parser import Parsed, Parser, Term, rewrite_aliases
from quern.plans.predicates import UnsupportedFilter, compile_filter

MODES = ("smart", "exact", "semantic")
#: Codes of what a result may warn of.
WARN_FILTER, WARN_UNFINISHED, WARN_EXACT, WARN_CORRECTED, WARN_SEMANTIC = "filter_not_applied", "unfinished_filter", "evaluated_exactly", "corrected", "semantic_unavailable"
RESULT = (
    "query_id int, position int, note_id bigint, score double, matched int, total int, reasons array<struct<kind:string,label:string,weight:double>>, "
    "title string, snippet string, total_candidates bigint"
)


@dataclass
class Index:
    """The tables of one index version."""

    prepared: DataFrame
    counts: DataFrame
    postings: DataFrame
    terms: DataFrame
    vocabulary: DataFrame
    #: The vocabulary of the notes alone, ``(term, frequency)``.
    words: DataFrame | None = None
    aliases: DataFrame | None = None
    corpus: tuple[int, float] = field(default=(0, 1.0))
    shards: int | None = None

    @staticmethod
    def build(notes: DataFrame, aliases: DataFrame | None = None, single_field: bool = False) -> Index:
        """An index of a small collection, kept by the session until ``release``."""
        prepared = (index.prepare_single_field(notes) if single_field else index.prepare(notes)).persist(StorageLevel.MEMORY_AND_DISK)
        counts = index.term_counts(prepared)
        words_ = index.vocabulary(prepared)
        return Index(prepared, counts, index.postings(prepared), counts.groupBy("term").agg(F.count("*").alias("df")), fuzzy.build_vocabulary(words_, aliases), words_, aliases, lexical.corpus_size(index.doc_stats(prepared)))

    @staticmethod
    def open(versions: Versions) -> Index:
        """The last published version; an older one stays readable until it is pruned."""
        read, keys = versions.read_all(), versions.entry()["keys"]
        if "prepared" not in read:
            raise ValueError(f"no index is published under {versions.root}")
        aliases = read.get("aliases")
        words_ = read["vocabulary"].select("term", "frequency")
        return Index(read["prepared"], read["counts"], read["postings"], read["terms"], fuzzy.build_vocabulary(words_, aliases), words_, aliases, (keys["n_notes"], keys["mean_length"]), keys["shards"])

    def release(self) -> None:
        self.prepared.unpersist()


def _tokens(term: str) -> list[str]:
    return regex.findall(INDEX_TOKEN, term)


def corrected_terms(terms: tuple[Term, ...], automatic: dict[str, str]) -> tuple[Term, ...]:
    out = []
    for t in terms:
        text = " ".join(automatic.get(w, w) for w in words(t.normalized))
        out.append(t if t.quoted or text == " ".join(words(t.normalized)) else Term(text, normal(text), t.quoted, t.negated))
    return tuple(out)


class Engine:
    def __init__(self, spark: SparkSession, idx: Index):
        self.spark, self.index = spark, idx

    # -- parsing ---------------------------------------------------------------------

    @staticmethod
    def parse(texts: list[str], field_names=(), typing: bool = False) -> tuple[list[Parsed], list[list[str]]]:
        """Parsed queries and their warnings. ``typing`` leaves out filters that are still being written."""
        parser, parsed, warnings = Parser(field_names), [], []
        for text in texts:
            text, unfinished = parser.complete(rewrite_aliases(text or "")) if typing else (rewrite_aliases(text or ""), ())
            found = parser.parse(text)
            notes = [*found.warnings, *([WARN_UNFINISHED] if unfinished else [])]
            if found.filter_query and not found.exact_only:
                try:
                    compile_filter(found.filter_query)
                except UnsupportedFilter:
                    notes.append(WARN_FILTER)
            parsed.append(found)
            warnings.append(notes)
        return parsed, warnings

    def warnings(self, texts: list[str], mode: str = "smart", field_names=(), typing: bool = False) -> DataFrame:
        """``(query_id, warning)`` of queries: what was left out, read differently or corrected."""
        parsed, found = self.parse(texts, field_names, typing)
        rows = [(q, w) for q, notes in enumerate(found) for w in notes]
        if mode == "smart":
            corrections = self.corrections(parsed)
            rows += [(q, WARN_CORRECTED) for q, p in enumerate(parsed) if not p.exact_only and self._effective(p, mode, corrections)[0]]
        return self.spark.createDataFrame(rows, "query_id int, warning string")

    # -- driver-side lookups of a few tokens -----------------------------------------

    def corrections(self, parsed: list[Parsed]) -> dict[str, dict]:
        tokens = sorted({w for p in parsed if not p.exact_only for t in p.positive if not t.quoted for w in words(t.normalized)})
        if not tokens:
            return {}
        asked = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        found = fuzzy.corrections(fuzzy.suggestions(asked, self.index.vocabulary)).collect()  # one row a query word at most
        return {r.token: r.asDict() for r in found}

    def expansions(self, terms: list[Term]) -> dict[str, list[str]]:
        """Aliases of whole terms and of their words, for all queries in one lookup."""
        if self.index.aliases is None or not terms:
            return {}
        values = sorted({v for t in terms for v in (t.normalized, *words(t.normalized))})
        asked = self.spark.createDataFrame([(v,) for v in values], "value string")
        out: dict[str, list[str]] = {}
        for r in fuzzy.expand_aliases(asked, self.index.aliases).orderBy("value", "expanded").collect():
            out.setdefault(r.value, []).append(r.expanded)
        return out

    # -- retrieval -------------------------------------------------------------------

    def _sources(self, plans: list[dict], limit: int) -> DataFrame | None:
        """``(query_id, note_id, source, rank)`` of all lexical sources of all queries."""
        singles, phrases, clauses, wanted = [], {}, [], []
        for q, plan in enumerate(plans):
            for source, groups in plan["sources"].items():
                wanted.append((f"{q}|{source}", len(groups)))
                for g, alternatives in enumerate(groups):
                    for a in alternatives:
                        if len(a) == 1:
                            singles.append((f"{q}|{source}", g, a[0]))
                        else:
                            clauses.append((f"{q}|{source}", g, phrases.setdefault(a, len(phrases))))
        if not wanted:
            return None
        idx, parts = self.index, []
        if singles:
            asked = self.spark.createDataFrame(singles, "query_id string, group_id int, term string")
            parts.append(lexical.word_parts(idx.counts, idx.terms, asked, idx.corpus, idx.shards))
        if phrases:
            rows = self.spark.createDataFrame([(i, list(p)) for p, i in phrases.items()], "phrase_id int, tokens array<string>")
            of_group = self.spark.createDataFrame(clauses, "query_id string, group_id int, phrase_id int")
            parts.append(lexical.phrase_parts(idx.postings, rows, of_group, idx.terms, idx.corpus, idx.shards))
        matches = lexical.matched(*parts).withColumn("source", F.substring_index("query_id", "|", -1))
        matches = join_small(matches, self.spark.createDataFrame(wanted, "query_id string, wanted int"), "query_id")
        matches = matches.where((F.col("source") == "literal_broad") | (F.col("groups") == F.col("wanted")))
        cap = F.when(F.col("source") == "literal_broad", fusion.source_limit("literal_broad", limit)).otherwise(fusion.source_limit("", limit))
        best = lexical.ranked(matches, fusion.source_limit("literal_broad", limit)).where(F.col("rank") <= cap)
        return best.select(F.substring_index("query_id", "|", 1).cast("int").alias("query_id"), "note_id", "source", "rank")

    @staticmethod
    def _effective(parsed: Parsed, mode: str, corrections: dict[str, dict]) -> tuple[dict[str, str], tuple[Term, ...]]:
        """Corrections that are applied, and the positive terms after them."""
        positive = parsed.positive
        automatic = {w: c["corrected"] for w, c in corrections.items() if c["automatic"] and mode != "exact" and any(w in words(t.normalized) and not t.quoted for t in positive)}
        return automatic, corrected_terms(positive, automatic) if automatic else positive

    def _plan(self, parsed: Parsed, mode: str, automatic: dict[str, str], effective: tuple[Term, ...], known: dict[str, list[str]]) -> dict:
        positive = parsed.positive
        groups = [[tuple(_tokens(t.normalized))] for t in positive if _tokens(t.normalized)]
        expansions = {v: known[v] for t in effective for v in (t.normalized, *words(t.normalized)) if v in known}
        sources: dict[str, list] = {}
        if mode != "semantic" and groups:
            sources["literal_strict"] = groups
            if len(positive) > 1:
                sources["literal_broad"] = groups
            if automatic:
                sources["corrected"] = [[tuple(_tokens(t.normalized))] for t in effective if _tokens(t.normalized)]
            if expansions:
                sources["alias"] = [[tuple(x) for x in dict.fromkeys(tuple(_tokens(v)) for v in (t.normalized, *self._expanded(t, expansions))) if x] for t in effective]
        concepts = []
        for t in effective:
            own = words(t.normalized)
            if own:
                others = [words(v) for v in self._expanded(t, expansions, whole=True)]
                concepts.append([{"text": " ".join(own), "phrase": t.quoted or len(own) > 1}, *({"text": " ".join(o), "phrase": len(o) > 1} for o in others if o)])
        return {
            "sources": sources, "concepts": concepts, "automatic": automatic, "expansions": expansions,
            "query_tokens": [w for t in positive for w in words(t.normalized)],
            "phrases": [t.normalized for t in positive if t.quoted],
            "negatives": [{"text": t.normalized if t.quoted or len(words(t.normalized)) > 1 else (words(t.normalized) or [""])[0], "phrase": t.quoted or len(words(t.normalized)) > 1} for t in parsed.negative],
            "needles": [t.text for t in effective],
        }

    @staticmethod
    def _expanded(term: Term, expansions: dict[str, list[str]], whole: bool = False) -> list[str]:
        keys = [term.normalized] if whole else [term.normalized, *words(term.normalized)]
        return list(dict.fromkeys(e for k in keys for e in expansions.get(k, [])))

    def search(self, texts: list[str], mode: str = "smart", limit: int = 50, field_names=(), semantic: DataFrame | None = None, typing: bool = False) -> DataFrame:
        """Results of all queries (``RESULT``); ``warnings`` tells what was read differently.

        ``semantic(query_id, note_id, rank, similarity)`` are vector hits for semantic mode
        (``vector_store.VectorStore.search`` gives them). A query whose filters cannot be
        compiled has no results. Queries of filters alone list notes in id order with score
        1; queries that only exact evaluation can answer list them without a score.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        limit = fusion.bounded_limit(limit)
        parsed, _ = self.parse(texts, field_names, typing)
        ranked = [p if not p.exact_only else Parsed(p.raw) for p in parsed]
        corrections = self.corrections(ranked) if mode != "exact" else {}
        terms = [self._effective(p, mode, corrections) for p in ranked]
        known = self.expansions([t for _, ts in terms for t in ts]) if mode == "smart" else {}
        plans = [self._plan(p, mode, a, ts, known) for p, (a, ts) in zip(ranked, terms, strict=True)]
        hits = self._sources(plans, limit)
        fused = fusion.reciprocal_ranks(hits).withColumn("similarity", F.lit(None).cast("double")) if hits is not None else None
        if mode == "semantic" and semantic is not None:
            capped = semantic.where(F.col("rank") <= max(100, 3 * limit))
            fused = fusion.semantic_scores(capped).select("query_id", "note_id", "score", "similarity", F.create_map().cast("map<string,int>").alias("source_ranks"))
        outputs = [self._ranked(fused, ranked, plans, mode, limit)] if fused is not None else []
        outputs += [x for q, p in enumerate(ranked) if not p.positive and p.filter_query and (x := self._filtered(q, p, plans[q], limit)) is not None]
        outputs += [x for q, p in enumerate(parsed) if p.exact_only and (x := self._exactly(q, p, limit)) is not None]
        if not outputs:
            return self.spark.createDataFrame([], RESULT)
        out = outputs[0]
        for more in outputs[1:]:
            out = out.unionByName(more)
        return out

    def _cards(self) -> DataFrame:
        notes = self.index.prepared
        return notes if "cards" in notes.columns else notes.withColumn("cards", F.array().cast("array<struct<flag:int,suspended:boolean,buried:boolean>>"))

    def _allowed(self, parsed: list[Parsed]) -> tuple[DataFrame | None, list[int], list[int]]:
        """``(query_id, note_id)`` that the queries' filters let pass, of one scan; queries without and with a bad filter."""
        tests, free, bad = [], [], []
        for q, p in enumerate(parsed):
            if not p.filter_query:
                free.append(q)
                continue
            try:
                tests.append(F.when(compile_filter(p.filter_query), F.lit(q)))
            except UnsupportedFilter:
                bad.append(q)
        if not tests:
            return None, free, bad
        passed = self._cards().select("note_id", F.explode(F.array_compact(F.array(*tests))).alias("query_id"))
        return passed, free, bad

    def _ranked(self, fused: DataFrame, parsed: list[Parsed], plans: list[dict], mode: str, limit: int) -> DataFrame:
        schema = "query_id int, concepts array<array<struct<text:string,phrase:boolean>>>, query_tokens array<string>, phrases array<string>, negatives array<struct<text:string,phrase:boolean>>, needles array<string>"
        about = self.spark.createDataFrame([(q, p["concepts"], p["query_tokens"], p["phrases"], p["negatives"], p["needles"]) for q, p in enumerate(plans)], schema)
        docs = self.index.prepared.select("note_id", "title", "plain_fields", "normalized_text", tokenize(F.col("normalized_text")).alias("tokens"), tokenize(F.lower("title")).alias("title_tokens"))
        # a few hundred fused rows a query meet the notes; the queries themselves are tiny
        rows = join_small(join_small(docs, fused, "note_id"), about, "query_id")
        rows = rows.where(~fusion.contains_negative(F.col("normalized_text"), F.col("tokens"), F.col("negatives")))
        rows = fusion.coverage(fusion.boosted(rows))
        if mode == "smart":
            rows = fusion.smart_cutoff(rows)
        elif mode == "semantic":
            rows = fusion.semantic_cutoff(rows, F.col("has_phrase") | F.col("has_all"))
        allowed, free, bad = self._allowed(parsed)
        kept = rows.where(F.col("query_id").isin(*free)) if free else rows.where("false")
        if allowed is not None:
            kept = kept.unionByName(rows.where(~F.col("query_id").isin(*free, *bad)).join(allowed, ["query_id", "note_id"], "left_semi"))
        best = fusion.limited(kept, limit)
        shown = best.withColumn("lines", display_lines(F.col("plain_fields"), F.col("needles"), F.col("note_id")))
        return self._shown(shown, F.col("query_id"), F.col("position"), F.round("score", 8), F.col("matched"), F.col("total"), fusion.reasons())

    @staticmethod
    def _shown(rows: DataFrame, query, position, score, matched, total, reasons) -> DataFrame:
        title = F.coalesce(F.when(F.col("lines.primary") != "", F.col("lines.primary")), F.col("title"))
        return rows.select(query.alias("query_id"), position.alias("position"), "note_id", score.alias("score"), matched.alias("matched"), total.alias("total"), reasons.alias("reasons"), title.alias("title"), F.col("lines.support").alias("snippet"), "total_candidates")

    def _listed(self, q: int, rows: DataFrame, limit: int, score, kind: str, label: str) -> DataFrame:
        """The first notes in id order, with the number of all of them counted in the same plan."""
        total = rows.agg(F.count("*").alias("total_candidates"))
        first = rows.orderBy("note_id").limit(limit).crossJoin(F.broadcast(total))  # one row
        shown = first.withColumn("lines", display_lines(F.col("plain_fields"), F.array().cast("array<string>"), F.col("note_id")))
        reason = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(1.0).alias("weight")))
        return self._shown(shown, F.lit(q), F.row_number().over(Window.orderBy("note_id")), score, F.lit(0), F.lit(0), reason)

    def _filtered(self, q: int, parsed: Parsed, plan: dict, limit: int) -> DataFrame | None:
        try:
            allowed = self._cards().where(compile_filter(parsed.filter_query))
        except UnsupportedFilter:
            return None
        negatives = F.from_json(F.lit(json.dumps(plan["negatives"])), "array<struct<text:string,phrase:boolean>>")
        rows = allowed.where(~fusion.contains_negative(F.col("normalized_text"), tokenize(F.col("normalized_text")), negatives))
        return self._listed(q, rows, limit, F.lit(1.0), "filter", "Matches the filters")

    def _exactly(self, q: int, parsed: Parsed, limit: int) -> DataFrame | None:
        try:
            rows = self._cards().where(compile_filter(parsed.raw))
        except UnsupportedFilter:
            return None
        return self._listed(q, rows, limit, F.lit(None).cast("double"), "native", "Exact search")

    def exact(self, expression: str, limit: int = 50) -> DataFrame:
        """Evaluate the whole expression as a predicate: first notes in id order, no score."""
        found = self._cards().where(compile_filter(expression)).orderBy("note_id").limit(fusion.bounded_limit(limit))
        return found.select("note_id", "title", F.lit(None).cast("double").alias("score"))

    def responses(self, results: DataFrame, cards: DataFrame | None = None, limit: int = 50) -> DataFrame:
        """Rows for display: card ids in scope, and whether a query has more than is shown.

        ``cards(note_id, card_id)`` is the scope; its cards replace those of the note, and
        notes without a card in it are left out.
        """
        own = self.index.prepared.select("note_id", "card_ids")
        if cards is not None:
            own = cards.groupBy("note_id").agg(F.array_sort(F.collect_set("card_id")).alias("card_ids"))
        rows = join_small(own, results, "note_id").where(F.size("card_ids") > 0)
        return rows.withColumn("truncated", F.col("total_candidates") > limit)
