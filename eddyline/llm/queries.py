"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import clustering, exact_dedup, jaccard, licences, mixing, packing, periodic, pii, quality, substring_dedup, toxicity, transport, url_rules
from .common import read

#: (host, path, verdict)
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Shares of the mixture; sources without one of their own share that of the rest.
WEIGHTS = {"src0": 6, **{f"src{i}": 3 for i in range(1, 10)}, mixing.REST: 12}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_transport(spark, sf_dir):
    return transport.transport_digests(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op4_url_rules(spark, sf_dir):
    return url_rules.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_pfair_mix(spark, sf_dir):
    return mixing.schedule(read(spark, sf_dir, "documents"), WEIGHTS)


def op6_weak_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"))


def op7_licences(spark, sf_dir):
    return licences.scan(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.span_digests(read(spark, sf_dir, "documents"))


def op10_pack(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_toxicity(spark, sf_dir):
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_periodic_runs(spark, sf_dir):
    return periodic.periodic_runs(read(spark, sf_dir, "documents"), planted=True)


def op13_lloyd(spark, sf_dir):
    return clustering.clustered(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_transport, op2_exact_dedup, op3_jaccard_join, op4_url_rules, op5_pfair_mix, op6_weak_quality, op7_licences, op8_substring_dedup, op9_pii, op10_pack, op11_toxicity, op12_periodic_runs, op13_lloyd)}

#: One round of op13: vectors to their nearest centroid, then centroids to the floor of the mean.
_LLOYD = """a{n} as (select r, min(d * 16 + c) p from (select v.r, c, sum((v.q - m.q) * (v.q - m.q)) d from v join c{m} m using (i) group by 1, 2) group by 1),
        n{n} as (select cast(p % 16 as bigint) c, v.i, cast(sum(v.q) as bigint) s, count(*) n from a{n} join v using (r) group by 1, 2),
        c{n} as (select c, i, coalesce((s - ((s % n) + n) % n) // n, m.q) q from c{m} m left join n{n} using (c, i)),"""

SQL = {
    "op13_lloyd": """
        with k as (select vec_id, cast(embedding as double[]) e, row_number() over () r from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        v as (select vec_id, r, i, cast(floor(e[i] * 64) as bigint) q from (select vec_id, r, e, unnest(range(1, 65)) i from k)),
        f as (select r, row_number() over (order by sha256('1:' || vec_id)) - 1 c from k qualify c < 16),
        c0 as (select c, i, q from f join v using (r)),"""
    + "".join(_LLOYD.format(n=n, m=n - 1) for n in (1, 2, 3))
    + """
        a as (select r, min(d * 16 + c) p from (select v.r, c, sum((v.q - m.q) * (v.q - m.q)) d from v join c3 m using (i) group by 1, 2) group by 1),
        t as (select c, sha256(string_agg(cast(q as varchar), ',' order by i)) x from c3 group by 1)
        select vec_id, cast(p % 16 as int) as cluster, cast(p // 16 as bigint) as distance, cast(sum(p // 16) over (partition by p % 16) as bigint) as cluster_inertia, cast(sum(p // 16) over () as bigint) as inertia, x as centroid_sha256
        from a join k using (r) join t on t.c = p % 16""",
    "op3_jaccard_join": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
        s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') x from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i from d where len(w) > 0)),
        sets as (select doc_id, count(*) n, md5(string_agg(x, chr(10) order by x)) id from s group by 1),
        classes as (select id, min(doc_id) c, min(n) n from sets group by 1),
        shown as (select c, x from classes join s on s.doc_id = c),
        links as (select a, b from (select p.c a, q.c b, count(*) m from shown p join shown q on p.x = q.x and p.c <> q.c group by 1, 2) join classes p on p.c = a join classes q on q.c = b where 100 * m >= 80 * (p.n + q.n - m)),
        reach as (select c, c r from classes union select l.b, reach.r from reach join links l on l.a = reach.c where reach.r < l.b),
        roots as (select c, min(r) r from reach group by 1),
        degrees as (select a c, count(*) k from links group by 1)
        select d.doc_id, coalesce(sets.n, 0) as n_shingles, coalesce(r, d.doc_id) as component_id, classes.c as class_id, coalesce(k, 0) as n_links
        from d left join sets on sets.doc_id = d.doc_id left join classes using (id) left join roots on roots.c = classes.c left join degrees on degrees.c = classes.c""",
    "op8_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        windows as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) x from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) i from (select doc_id, i, min(doc_id) over (partition by x) least from windows) where least < doc_id),
        words as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from d),
        kept as (select doc_id, count(*) n, string_agg(word, ' ' order by i) t from words anti join gone using (doc_id, i) group by 1)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op2_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(x) as text_sha256
        from t window w as (partition by x)""",
    "op4_url_rules": """
        with p as (select page_id, url from pages),
        h as (select page_id,
            translate(coalesce(case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) end, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) end, '') as path from p),
        r(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        j as (select page_id, host, path, rh || rp as rule, rv, length(rh || rp) as size from h left join r on (host = rh or host like '%.' || rh) and starts_with(path, rp))
        select page_id, host, path, arg_max(rule, size) as rule, coalesce(arg_max(rv, size), 'allow') as verdict, cast(count(rule) as int) as n_rules from j group by all""",
}
