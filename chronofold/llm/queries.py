"""One query for each operator of this subpackage, over its whole table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import (
    binary_output,
    collocations,
    decontaminate,
    embedding_dedup,
    exact_search,
    html_text,
    near_dedup,
    packing,
    quality,
    secrets,
    substring_dedup,
    url_filter,
    word_runs,
)
from chronofold.llm.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_url_filter",
    """
    with rest as (
      select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    parts as (
      select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
    rules as (
      select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, a)),
    best as (
      select page_id, host, path, max_by(h || p, length(h || p)) as rule, max_by(a, length(h || p)) as verdict
      from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
    select q.page_id, q.host, q.path, b.rule, coalesce(b.verdict, 'allow') as verdict
    from parts q left join best b on q.page_id = b.page_id and q.host = b.host and q.path = b.path
    """,
)
def _(s, d):
    rules = url_filter.rule_table(s, url_filter.RULES)
    judged = url_filter.judge_urls(table(s, d, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_repeated_strings")
def _(s, d):
    return substring_dedup.remove_repeats(table(s, d, "documents"))


def _secret_sql() -> str:
    steps = [
        f"""select doc_id, {i} as n, '{r.kind}' as kind, {r.least} as least,
              regexp_extract_all(text, '{r.pattern.replace("'", "''")}', 0) as hits,
              regexp_extract_all(text, '{r.pattern.replace("'", "''")}', {r.group}) as held,
              string_split_regex(text, '{r.pattern.replace("'", "''")}') as gaps from texts"""
        for i, r in enumerate(secrets.RULES)
    ]
    return f"""
    with texts as (select doc_id, coalesce(text, '') as text from documents),
    found as ({" union all ".join(steps)}),
    rows as (
      select doc_id, n, kind, least, i, length(hits[i]) as width, length(held[i]) as held, length(gaps[i]) as gap
      from (select *, unnest(range(1, len(hits) + 1)) as i from found)),
    ends as (select *, sum(gap + width) over (partition by doc_id, n order by i) as e from rows),
    spans as (select doc_id, n, kind, e - width as s, e from ends where held >= least),
    docs as (
      select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, n) as spans from spans group by doc_id)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
    from texts t left join docs d on t.doc_id = d.doc_id
    """


@query("op3_secret_scan", _secret_sql())
def _(s, d):
    docs, ledger = table(s, d, "documents"), Scratch(s).path("ledger")
    secrets.start_ledger(s, ledger)
    # Two deliveries: of the second only blobs that the first did not hold are scanned.
    for delivery in ("lang <=> 'en'", "not (lang <=> 'en')"):
        secrets.extend_ledger(docs.where(delivery), ledger)
    found = secrets.document_findings(docs, secrets.read_ledger(s, ledger))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op4_best_fit_packing")
def _(s, d):
    rows = packing.best_fit_packing(table(s, d, "documents"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_quality_classifier")
def _(s, d):
    return quality.classify(table(s, d, "documents"), table(s, d, "labels"))


@query("op6_html_extraction")
def _(s, d):
    return html_text.extract_pages(table(s, d, "pages"))


@query(
    "op7_exact_top_k",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as items from embeddings
      where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
      select q.vec_id as query_id, x.vec_id, cast(list_inner_product(q.items, x.items) as bigint) as score
      from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 50 = 0),
    ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
)
def _(s, d):
    return exact_search.exact_top_k(table(s, d, "embeddings"))


@query(
    "op8_minhash_near_dedup",
    """
    with recursive w as (
      select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    sets as (
      select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda t: t[1] || ' ' || t[2] || ' ' || t[3])) end as s from w),
    every as materialized (select doc_id, len(s) as n, unnest(s) as item from sets),
    items as (select * from every where item in (select item from every group by item having count(*) > 1)),
    common as (
      select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c
      from items a join items b on a.item = b.item and a.doc_id <> b.doc_id group by 1, 2),
    links as (select a, b from common where 100 * c >= 85 * (an + bn - c)),
    reach(doc_id, other) as (
      select doc_id, doc_id from sets union select r.doc_id, l.b from reach r join links l on l.a = r.other),
    least as (select doc_id, min(other) as component_id from reach group by 1)
    select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
    """,
)
def _(s, d):
    return near_dedup.near_duplicates(table(s, d, "documents"), k=3, threshold=Fraction(85, 100))


@query("op9_token_files")
def _(s, d):
    scratch = Scratch(s)
    path = scratch.path("ids")
    binary_output.write_token_files(table(s, d, "documents"), path)
    return binary_output.read_token_files(s, path)


@query("op10_benchmark_decontamination")
def _(s, d):
    return decontaminate.find_copies(table(s, d, "documents"), table(s, d, "benchmark"), least_words=1)


@query(
    "op11_phrase_collocations",
    """
    with t as (
      select coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
    w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
    grams as (select lang, m as size, unnest([array_to_string(w[i : i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) as phrase
      from w cross join (values (1), (2), (3)) s(m)),
    f as materialized (select lang, phrase, size, count(*) as f from grams group by all),
    c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 10),
    cuts as (select lang, phrase, size, a, w, unnest(range(1, size)) as k from c),
    scored as (
      select c.lang, c.phrase, c.size, a, k, x.f as l, y.f as r,
        cast(1000000::hugeint * a * a // (x.f::hugeint * y.f) as bigint) as score
      from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(w[1 : k], ' ')
        join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1 :], ' ')),
    least as (select lang, phrase, size, a, min({'score': score, 'k': k, 'l': l, 'r': r}) as cut from scored group by all),
    inner_ as (
      select lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) as phrase from c where size = 3),
    longer as (select lang, phrase, max(a) as longer from inner_ group by all),
    ranked as (
      select lang, phrase, a, cut, row_number() over (partition by lang order by cut.score desc, a desc, phrase) as rank
      from least left join longer using (lang, phrase) where coalesce(100 * longer < 50 * a, true)),
    total as (select lang, cast(sum(f) as bigint) as n from f where size = 1 group by 1)
    select lang, rank, phrase, a, cut.l as l, cut.r as r, n, cut.score as score from ranked join total using (lang) where rank <= 2000
    """,
)
def _(s, d):
    return collocations.phrase_collocations(table(s, d, "documents"))


@query("op12_word_runs")
def _(s, d):
    return word_runs.find_runs(table(s, d, "documents"), fold=True).drop("runs")


@query(
    "op13_embedding_dedup",
    """
    with recursive v as materialized (
      select vec_id, list_transform(embedding, lambda x: cast(x as double)) as x, len(embedding) as dim from embeddings
      where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as materialized (
      select a.vec_id as a, b.vec_id as b from v a join v b on a.dim = b.dim and a.vec_id <> b.vec_id
      where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.9),
    reach(vec_id, other) as (
      select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.other),
    least as (select vec_id, min(other) as component_id from reach group by 1),
    counts as (select a as vec_id, count(*) as n from links group by 1)
    select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
    from embeddings join least using (vec_id) left join counts using (vec_id)
    """,
)
def _(s, d):
    return embedding_dedup.near_duplicate_vectors(table(s, d, "embeddings"))
