"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick (operator 6).

A term counts where neither neighbour is a letter or digit of a-z0-9. A term of weight STRICT or more is strict, the others
are soft. A url goes on one strict term or on SOFT distinct soft ones; the longest rule that fits decides before the
vocabulary does. The vocabulary is made by rule from stems of four languages and their endings, and of lures joined to
wares; `terms_of` reads one from a table instead.

Defined results: a null url, or one without ://, has empty host and path, so no rule fits; a null url holds no term.
An empty table gives no rows; rows that repeat are judged one by one. Other columns are not looked at and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.worker import cache, lean

#: Weight from which a term is strict, and how many distinct soft terms reject a url.
STRICT, SOFT = 2, 2
#: Most terms that are read from a table: the automaton is held by every worker.
MOST = 1_000_000
# Stems of things that are sold or shown, lures that stand before them, and endings, by language.
STRICT_STEMS = {
    "en": "porn xxx casino viagra cialis malware warez camgirl escort keygen",
    "de": "porno spielcasino potenzmittel raubkopie sexkontakt erotikfilm",
    "fr": "porno casino escorte arnaque logicielpirate sexe",
    "es": "porno casino escorts estafa sexo pirateo",
}
WARES = {
    "en": "bet pill loan poker slot jackpot lottery drug replica ads download movie ringtone credit diet",
    "de": "wette pille kredit poker lotto gewinn droge replik werbung klingelton spiel",
    "fr": "pari pilule pret poker loto gain drogue replique pub sonnerie jeu",
    "es": "apuesta pildora prestamo poker loteria premio droga replica anuncio tono juego",
}
LURES = {
    "en": "free cheap win adult bonus click deal instant secret hot track buy",
    "de": "gratis billig gewinne bonus klick sofort heiss kaufe",
    "fr": "gratuit gagner adulte bonus clic promo achat direct",
    "es": "gratis barato gana adulto bonus oferta compra directo",
}
ENDINGS = {"en": ("", "s", "er", "ing", "online", "site"), "de": ("", "n", "en", "s", "online", "seite"), "fr": ("", "s", "x", "enligne", "site"), "es": ("", "s", "es", "enlinea", "sitio")}


def vocabulary() -> dict[str, int]:
    """Term to weight: inflected stems (strict ones without the plural s, so that a stem's own boundaries count), wares and lures alone as soft ones, and a lure joined to a ware as a strict one."""
    soft = {x + e for lang, ends in ENDINGS.items() for x in WARES[lang].split() for e in ends} | {x for xs in LURES.values() for x in xs.split()}
    strict = {x + e for lang, ends in ENDINGS.items() for x in STRICT_STEMS[lang].split() for e in ends if e != "s"}
    strict |= {a + by + x + e for lang, ends in ENDINGS.items() for a in LURES[lang].split() for x in WARES[lang].split() for e in ends[:2] for by in ("", "-")}
    return dict.fromkeys(sorted(soft), 1) | dict.fromkeys(sorted(strict), STRICT)


TERMS = vocabulary()
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def found_terms(automaton, url: str | None) -> set[str]:
    """Distinct terms of a lower-cased url that stand between boundaries."""
    if not url:
        return set()
    edge = lambda i: not (0 <= i < len(url) and (url[i] in "0123456789" or url[i] in LOWER))
    return {t for end, t in automaton.iter(url) if edge(end + 1) and edge(end - len(t))}


def _automaton(terms):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def terms_of(table: DataFrame, most: int = MOST) -> dict[str, int]:
    """A vocabulary from a table (term, weight) of at most so many terms."""
    rows = table.where("term <> ''").groupBy(F.translate("term", UPPER, LOWER).alias("term")).agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return {r.term: r.weight for r in rows}


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, terms: dict[str, int] = TERMS, strict: int = STRICT, soft: int = SOFT, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, strict_hits, soft_hits (distinct terms)."""
    kind = dict(pages.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = cache("urls", hash(frozenset(terms)), lambda: _automaton(terms))
        for b in batches:
            hits = [found_terms(a, x) for x in b.column(1).to_pylist()]
            hard = [sum(terms[t] >= strict for t in h) for h in hits]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hard, pa.int32()), pa.array([len(h) - n for h, n in zip(hits, hard, strict=True)], pa.int32())], names=["id", "url", "strict_hits", "soft_hits"])

    lower = F.translate(F.col(url_col), UPPER, LOWER)
    counted = pages.select(pages[id_col].alias("id"), lower.alias("lower"), F.col(url_col).alias("url")).mapInArrow(lean(run), f"id {kind}, url string, strict_hits int, soft_hits int")
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = counted.select("id", "strict_hits", "soft_hits", rest.alias("rest"))
    cut = cut.select("id", "strict_hits", "soft_hits", F.translate(F.substring_index(F.substring_index(F.substring_index("rest", "/", 1), "?", 1), "#", 1), UPPER, LOWER).alias("host"), "rest")
    path = F.substring_index(F.substring_index(F.expr("substring(rest, char_length(host) + 1)"), "?", 1), "#", 1)
    judged = cut.select("id", "host", path.alias("path"), "strict_hits", "soft_hits")
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft), "block").otherwise("allow")
    for what, host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested last and so wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, host + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_hits")


def oracle(terms: dict[str, int] = TERMS, strict: int = STRICT, soft: int = SOFT, rules=RULES) -> str:
    """The same in SQL, for terms of one word or of two that are joined by a hyphen."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    return f"""
with a as (select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') low, coalesce(url, '') url, row_number() over () k from pages),
t(term, weight) as (values {", ".join(f"('{t}', {w})" for t, w in terms.items())}),
p as (select k, string_split(unnest(string_split_regex(low, '[^a-z0-9-]+')), '-') w from a),
g as (select k, unnest(w) term from p union select k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '-' || w[i + 1])) from p),
h as (select k, cast(count(case when weight >= {strict} then 1 end) as int) s, cast(count(case when weight < {strict} then 1 end) as int) n from g join t using (term) group by k),
b as (select a.*, coalesce(s, 0) strict_hits, coalesce(n, 0) soft_hits, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from a left join h on h.k = a.k),
c as (select *, regexp_extract(rest, '^[^/?#]*') raw_host from b),
d as (select page_id, translate(raw_host, '{UPPER}', '{LOWER}') host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') path, strict_hits, soft_hits from c)
select page_id, host, path, case {" ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in order)} end as rule,
       case {" ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in order)} when strict_hits > 0 or soft_hits >= {soft} then 'block' else 'allow' end as verdict,
       strict_hits, soft_hits from d"""
