"""The queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.labels import CATEGORIES, CHAPTERS, SUBSTANCES
from ..functions.text import HEADER_STEMS, SECTIONS, STOP_WORDS
from ..operators.keywords import ABBREVIATIONS, BRANDS, INDICATORS, noise_words
from ..operators.rank import RARITY
from .evaluate import STRATEGIES as EVALUATED
from .projections import LONG_TERMS, STRATEGIES, SYSTEMS, TERMS
from ..operators.resample import MASK, MULTIPLIERS, seed_base
from .queries import DRAWS, GAP_DRAWS, OVERLAP, PERMUTATIONS, SIZE


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _mixed(rows: str, *names: str) -> str:
    """``rows`` with whole numbers under 2^32 mixed."""
    a, b = MULTIPLIERS
    for step in ("xor({c}, {c}>>16)", f"({{c}}*{a})&{MASK}", "xor({c}, {c}>>15)", f"({{c}}*{b})&{MASK}", "xor({c}, {c}>>16)"):
        rows = "(SELECT * REPLACE (" + ", ".join(f"{step.format(c=c)} AS {c}" for c in names) + f") FROM {rows})"
    return rows


def _drawn(rows: str, seed: int, i: str, j: str) -> str:
    """``rows`` with x, a whole number under 2^32 drawn for (seed, i, j)."""
    own = _mixed(f"(SELECT *, ({i}+{seed_base(seed)})&{MASK} AS xi, ({j}+1)&{MASK} AS xj FROM {rows})", "xi", "xj")
    return _mixed(f"(SELECT * EXCLUDE (xi, xj), (xi+xj)&{MASK} AS x FROM {own})", "x")


def _boot_draws(n: str, n_iter: int, seed: int) -> str:
    """iter, pos: ``n`` draws with replacement for each iteration."""
    rows = f"(SELECT n, iter, j FROM (SELECT n, unnest(range({n_iter})) AS iter FROM {n}), LATERAL (SELECT unnest(range(n)) AS j))"
    return f"SELECT iter, (x*n)>>32 AS pos FROM {_drawn(rows, seed, 'iter', 'j')}"


def _list(xs) -> str:
    return ", ".join(_s(x) for x in xs)


#: RE2's word borders know ASCII only; any other character counts as a letter here.
_LETTERS = r"regexp_replace({0}, '[^\x00-\x7F]', 'x', 'g')"

_CTE = {
    "dx": """SELECT l_orderkey AS hadm_id, o_custkey AS subject_id, l_linenumber AS seq_num, l_partkey, l_suppkey,
      (CASE WHEN l_returnflag='N' THEN 'Z' ELSE 'F' END) || lpad((l_partkey%100)::varchar,2,'0') || (CASE WHEN l_suppkey%5=0 THEN '' ELSE (l_suppkey%10)::varchar END) AS raw
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "lab0": """SELECT hadm_id, min(subject_id) AS subject_id, string_agg(code, ', ' ORDER BY seq_num, l_partkey, l_suppkey, code) AS f_codes_str, count(*)::bigint AS f_code_count,
      min(seq_num)::bigint AS primary_seq FROM (SELECT *, CASE WHEN length(raw)>3 THEN substr(raw,1,3)||'.'||substr(raw,4) ELSE raw END AS code FROM dx WHERE raw LIKE 'F%') GROUP BY hadm_id""",
    "lab": "SELECT *, split_part(f_codes_str, ', ', 1) AS primary_f_code, substr(split_part(f_codes_str, ', ', 1),1,3) AS primary_category FROM lab0",
    "small": "SELECT min(c) AS m, min(c-floor(c*70/100.0)) AS l FROM (SELECT count(*) AS c FROM lab GROUP BY primary_category)",
    "numbered": """SELECT lab.*, row_number() OVER (PARTITION BY CASE WHEN m>=2 THEN primary_category ELSE '' END ORDER BY md5('42:'||hadm_id::varchar), hadm_id) AS rn,
      count(*) OVER (PARTITION BY CASE WHEN m>=2 THEN primary_category ELSE '' END) AS cnt FROM lab, small""",
    "rest": """SELECT *, rn<=floor(cnt*70/100.0) AS is_first, row_number() OVER (PARTITION BY rn<=floor(cnt*70/100.0) ORDER BY md5('42:'||hadm_id::varchar), hadm_id) AS r2,
      count(*) OVER (PARTITION BY rn<=floor(cnt*70/100.0)) AS c2 FROM numbered""",
    "split": """SELECT rest.* EXCLUDE (is_first, r2, c2), CASE WHEN is_first THEN 'train' WHEN CASE WHEN small.m>=2 AND small.l<2 THEN r2<=floor(c2/2.0) ELSE rn<=floor(cnt*85/100.0) END
      THEN 'val' ELSE 'test' END AS split FROM rest, small""",
    "inst": "SELECT hadm_id, unnest(string_split(f_codes_str, ', ')) AS f_code FROM lab",
    "freq": "SELECT f_code, count(*)::bigint AS n FROM inst GROUP BY 1",
    "cov": """SELECT row_number() OVER (ORDER BY n DESC, f_code) AS rank, f_code, n, sum(n) OVER (ORDER BY n DESC, f_code ROWS UNBOUNDED PRECEDING)::bigint AS cum,
      sum(n) OVER ()::bigint AS total FROM freq""",
    "sfreq": "SELECT split, f_code, count(*)::bigint AS n FROM (SELECT split, unnest(string_split(f_codes_str, ', ')) AS f_code FROM split) GROUP BY ALL",
    "scov": """SELECT split, row_number() OVER w AS rank, f_code, n, sum(n) OVER (PARTITION BY split ORDER BY n DESC, f_code ROWS UNBOUNDED PRECEDING)::bigint AS cum,
      sum(n) OVER (PARTITION BY split)::bigint AS total FROM sfreq WINDOW w AS (PARTITION BY split ORDER BY n DESC, f_code)""",
    "notes": "SELECT doc_id AS hadm_id, text, o_custkey AS subject_id FROM documents JOIN orders ON doc_id=o_orderkey",
    "cohort": "SELECT n.hadm_id, n.subject_id, n.text, f_codes_str, f_code_count, primary_seq, length(n.text)::bigint AS text_length, primary_f_code, primary_category FROM notes n JOIN lab USING (hadm_id, subject_id)",
    "tok": r"SELECT doc_id, text, coalesce(len(regexp_extract_all(text, '\S+')),0)::bigint AS n FROM documents",
    "chunks": f"""SELECT doc_id, i::bigint AS chunk_idx, total::bigint AS total_chunks, (i*{SIZE - OVERLAP})::bigint AS start_token, least(i*{SIZE - OVERLAP}+{SIZE}, n)::bigint AS end_token, text
      FROM (SELECT *, unnest(range(total)) AS i FROM (SELECT *, greatest(ceil((n-{OVERLAP})/{SIZE - OVERLAP}.0),1)::bigint AS total FROM tok))""",
    "ann": """SELECT doc_id, concat(CASE WHEN doc_id%2=0 THEN 'Social History:' ELSE 'Chief Complaint:' END, chr(10), text, chr(10),
      CASE doc_id%3 WHEN 0 THEN 'Discharge Diagnosis: ' WHEN 1 THEN 'Plan:' ELSE 'Medications on Admission:' END, chr(10), 'end.') AS text_ann FROM documents""",
    "hdr": r"SELECT header, count(*)::bigint AS n FROM (SELECT lower(trim(unnest(regexp_extract_all(text_ann, '(?m)^([A-Za-z][A-Za-z /\-]{2,40}):\s*$', 1)))) AS header FROM ann) GROUP BY 1",
    "hdrs": "SELECT header, n, " + " OR ".join(f"contains(header, {_s(x)})" for x in HEADER_STEMS) + " AS relevant FROM hdr",
    "termdf": " UNION ALL ".join(rf"SELECT {_s(t)} AS term, count(*) FILTER (WHERE regexp_matches({_LETTERS.format('lower(text)')}, '\b{t}\b'))::bigint AS n_docs FROM documents" for t in sorted(set(TERMS))),
    "ws": rf"""SELECT w AS word, is_diag FROM (SELECT unnest(regexp_extract_all(s, '[a-z'']+')) AS w, regexp_matches({_LETTERS.format('s')}, '\b({"|".join(sorted(TERMS, key=lambda t: (-len(t), t)))})\b') AS is_diag
      FROM (SELECT unnest(string_split(regexp_replace(regexp_replace(lower(text), '([.!?])\s+', '\1'||chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM documents))
      WHERE length(w)>=3 AND w NOT IN ({_list(STOP_WORDS)})""",
    "enr": "SELECT word, count(*) FILTER (WHERE is_diag)::bigint AS diag, count(*) FILTER (WHERE NOT is_diag)::bigint AS other FROM ws GROUP BY 1",
    "tot": "SELECT sum(diag)::double AS ad, sum(other)::double AS ao FROM enr",
    "strat": "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {str(t).lower()})" for k, n, t in STRATEGIES) + ") AS s(k, strategy, fine_tuned)",
    "ev": """SELECT k, strategy, l_orderkey AS sample_id, 'F'||lpad((l_partkey%40)::varchar,2,'0') AS code, bool_or(l_returnflag<>'N') AS a,
      bool_or((l_linenumber*(k+1)+l_suppkey)%(3+k)<>0) AS p FROM lineitem, strat GROUP BY ALL""",
    "sc": """SELECT k, strategy, sample_id, count(*) FILTER (WHERE a AND p)::bigint AS tp, count(*) FILTER (WHERE p AND NOT a)::bigint AS fp, count(*) FILTER (WHERE a AND NOT p)::bigint AS fn
      FROM ev GROUP BY ALL""",
    "scf": """SELECT *, CASE WHEN tp+fp+fn=0 THEN 1.0 WHEN tp+fp=0 THEN 0.0 ELSE tp::double/(tp+fp) END::double AS precision, CASE WHEN tp+fp+fn=0 THEN 1.0 WHEN tp+fn=0 THEN 0.0 ELSE tp::double/(tp+fn) END::double AS recall,
      CASE WHEN tp+fp+fn=0 THEN 1.0 ELSE 2.0*tp/(2*tp+fp+fn) END::double AS f1, (fp+fn=0)::int AS perfect_match FROM sc""",
    "pc0": """SELECT strategy, code AS f_code, count(*) FILTER (WHERE a)::bigint AS occurrences, count(*) FILTER (WHERE a AND p)::bigint AS tp, count(*) FILTER (WHERE p AND NOT a)::bigint AS fp,
      count(*) FILTER (WHERE a AND NOT p)::bigint AS fn FROM ev WHERE a OR p GROUP BY ALL""",
    "pc": """SELECT *, CASE WHEN tp+fp=0 THEN 0 ELSE tp::double/(tp+fp) END::double AS precision, CASE WHEN tp+fn=0 THEN 0 ELSE tp::double/(tp+fn) END::double AS recall,
      CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2.0*tp/(2*tp+fp+fn) END::double AS f1 FROM pc0""",
    "mic": """SELECT strategy, k, tp, fp, fn, tp::double/(tp+fp) AS micro_p, tp::double/(tp+fn) AS micro_r, 2.0*tp/(2*tp+fp+fn)::double AS micro_f1
      FROM (SELECT strategy, k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sc GROUP BY ALL)""",
    "trainp": "SELECT DISTINCT subject_id FROM split WHERE split='train'",
    "pat": "SELECT o_orderkey AS sample_id, o_custkey AS subject_id, o_custkey IN (SELECT subject_id FROM trainp) AS known FROM orders",
    "arr": "SELECT strategy, sample_id, list_sort(list(code) FILTER (WHERE a)) AS ac, list_sort(list(code) FILTER (WHERE p)) AS pcodes FROM ev GROUP BY ALL",
    "pos": "SELECT *, row_number() OVER (ORDER BY ('0x'||substr(md5(sample_id::varchar),1,2))::int, sample_id)-1 AS pos FROM (SELECT DISTINCT sample_id FROM sc)",
    "nn": "SELECT count(*) AS n FROM pos",
    "draw": _boot_draws("nn", DRAWS, 42),
    "boot": """SELECT iter, strategy, k, 2.0*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)) AS f1, (sum(tp)/sum(tp+fp))::double AS precision, (sum(tp)/sum(tp+fn))::double AS recall, avg((fp+fn=0)::int)::double AS exact_match FROM draw JOIN pos USING (pos) JOIN sc USING (sample_id) GROUP BY ALL""",
    "resp0": "SELECT sample_id, sample_id%6 AS kind, coalesce(list_sort(list(code) FILTER (WHERE p)), []) AS c FROM ev WHERE strategy='ZS' GROUP BY ALL",
}
_NEEDS = {
    "lab0": "dx", "lab": "lab0", "small": "lab", "numbered": "lab small", "rest": "numbered", "split": "rest small", "inst": "lab", "freq": "inst", "cov": "freq", "sfreq": "split", "scov": "sfreq",
    "cohort": "notes lab", "chunks": "tok", "hdr": "ann", "hdrs": "hdr", "enr": "ws", "tot": "enr", "ev": "strat", "sc": "ev", "scf": "sc", "pc0": "ev", "pc": "pc0", "mic": "sc",
    "trainp": "split", "pat": "trainp", "arr": "ev", "pos": "sc", "nn": "pos", "draw": "nn", "boot": "draw pos sc", "resp0": "ev",
}


def _with(needs: str, body: str, **extra: str) -> str:
    """``body`` behind the common tables that it needs, in order."""
    names: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, "").split():
            add(m)
        if n not in names:
            names.append(n)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({_CTE[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _case(column: str, table: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column}={_s(k)} THEN {_s(v)}" for k, v in table.items()) + f" ELSE {_s(default)} END"


_CATEGORY = "CASE " + " ".join(f"WHEN substr(code,1,3) IN ({_list(ps)}) THEN {_s(n)}" for n, ps in CATEGORIES.items()) + " ELSE 'Other' END"
_QUANT = "quantile_cont({0}, 0.025) AS lo, quantile_cont({0}, 0.975) AS hi"
_TUNED = [(k, n) for k, n, t in STRATEGIES if t]
_WORST = "2*tp+fp+fn"


def _sev() -> str:
    sev = "CASE WHEN length(f_code)<5 THEN 'Other' WHEN substr(f_code,5,1)='1' THEN 'Abuse' WHEN substr(f_code,5,1)='2' THEN 'Dependence' WHEN substr(f_code,5,1)='9' THEN 'Unspecified' ELSE 'Other' END"
    rem = "CASE WHEN length(f_code)<6 THEN 'Unknown' WHEN substr(f_code,6,1)='1' THEN 'In Remission' WHEN substr(f_code,6,1)='0' THEN 'Active' ELSE 'Unknown' END"
    part = lambda c, v, n: f"coalesce(sum(n) FILTER (WHERE rn<=5 AND {c}='{v}'),0)::bigint AS {n}"
    cols = [part("sev", v, f"n_{v.lower()}_top5") for v in ("Abuse", "Dependence", "Unspecified", "Other")]
    cols += [part("rem", "Active", "n_active_top5"), part("rem", "In Remission", "n_remission_top5"), part("rem", "Unknown", "n_unknown_top5")]
    return _with("freq", f"SELECT prefix, {_case('prefix', SUBSTANCES, '')} AS substance, sum(n)::bigint AS n_total, {', '.join(cols)} FROM (SELECT *, substr(f_code,1,3) AS prefix, row_number() OVER (PARTITION BY substr(f_code,1,3) ORDER BY n DESC, f_code) AS rn, {sev} AS sev, {rem} AS rem FROM freq WHERE substr(f_code,1,3) IN ({_list(SUBSTANCES)})) GROUP BY prefix")


def _rarity() -> str:
    dims = " UNION ALL ".join(f"SELECT {_s(n)} AS bucket, {lo}::bigint AS lo, {'NULL' if hi is None else hi}::bigint AS hi" for lo, hi, n in RARITY)
    return _with("freq", f"SELECT bucket, lo, hi, count(n)::bigint AS n_codes, round(count(n)*100.0/(SELECT count(*) FROM freq),6)::double AS pct_codes FROM ({dims}) d LEFT JOIN freq ON n>=lo AND (hi IS NULL OR n<=hi) GROUP BY ALL")


def _sections() -> str:
    parts = []
    for name, (pattern, _) in SECTIONS.items():
        hit = f"regexp_matches(lower(text_ann), '{pattern}')"
        before = f"string_split_regex(lower(text_ann), '{pattern}')[1]"
        parts.append(f"SELECT '{name}' AS section, CASE WHEN {hit} THEN len(regexp_extract_all({before}, '\\S+')) END AS pos FROM ann")
    body = f"""SELECT section, count(*)::bigint AS n_docs, count(pos)::bigint AS n_found, round(count(pos)*100.0/count(*),6)::double AS found_pct, round(avg(pos),6) AS mean_position,
      round(quantile_cont(pos,0.5),6)::double AS median_position, round(coalesce(count(*) FILTER (WHERE pos<={SIZE})*100.0/nullif(count(pos),0),0),6)::double AS within_pct,
      count(*) FILTER (WHERE pos>{SIZE})::bigint AS n_beyond FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"""
    return _with("ann", body)


def _extract() -> str:
    any_ = " OR ".join(f"contains(lower(s), {_s(t)})" for t in TERMS)
    return rf"""WITH sent AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1'||chr(1), 'g'), chr(1)) AS ss FROM documents),
      kept AS (SELECT doc_id, text, ss, list_filter(ss, lambda s: {any_}) AS k FROM sent), j AS (SELECT *, coalesce(array_to_string(k, ' '),'') AS x FROM kept)
      SELECT doc_id, CASE WHEN length(trim(x))<100 THEN 'full_text_fallback' ELSE 'psychiatric_extraction' END AS extraction_method, len(ss)::bigint AS n_sentences, len(k)::bigint AS n_kept,
      CASE WHEN length(trim(x))<100 THEN length(text) ELSE length(x) END::bigint AS extracted_length FROM j"""


#: The windows of all notes with codes.
_PIECES = r"""SELECT hadm_id, CASE WHEN total_chunks=1 THEN chunks.text ELSE array_to_string(regexp_extract_all(chunks.text, '\S+')[start_token+1:end_token], ' ') END AS piece
      FROM cohort JOIN chunks ON doc_id=hadm_id"""


def _evaluations() -> str:
    kinds = ", ".join(f"({_s(s.short_name)}, {s.keywords}, {s.checked}, {s.failed_chunks}::bigint)" for s in EVALUATED)
    return _with("cohort chunks", """SELECT strategy, hadm_id AS sample_id, subject_id, num_chunks, success, array_to_string(list_sort(p),'; ') AS predicted_codes, tp, len(p)-tp AS fp, len(a)-tp AS fn, round(2.0*tp/(len(a)+len(p)),6)::double AS f1
      FROM (SELECT *, len(list_intersect(a,p))::bigint AS tp FROM (SELECT strategy, success, CASE WHEN success THEN c ELSE failed END AS num_chunks, p, cohort.hadm_id, subject_id, list_distinct(string_split(f_codes_str,', ')) AS a FROM found JOIN cohort USING (hadm_id)))""",
      ext=_extract(), pieces=f"SELECT hadm_id, false AS keyed, length(piece) AS n FROM ({_PIECES}) UNION ALL SELECT hadm_id, true, extracted_length FROM cohort JOIN ext ON doc_id=hadm_id",
      st=f"SELECT * FROM (VALUES {kinds}) v(strategy, keyed, checked, failed)",
      found="""SELECT strategy, hadm_id, failed, bool_or(n%7<>0) AS success, count(*)::bigint AS c,
        list_distinct(flatten(list(CASE WHEN n%7=0 THEN [] WHEN checked THEN ['F'||lpad((n%40)::varchar,2,'0')] ELSE ['F'||lpad((n%40)::varchar,2,'0'), 'E'||(n%10)::varchar] END))) AS p FROM pieces JOIN st USING (keyed) GROUP BY ALL""")  # fmt: skip


def _factorial() -> str:
    cells = ", ".join(f"({_s(t)}, {step}, {_s(e)}, {len(system) + 1})" for t, step in (("cot", 37), ("simple", 23)) for e, system in SYSTEMS.items())
    code = "'F'||lpad((n%{})::varchar,2,'0')"
    return _with("cohort chunks", """SELECT train_prompt, eval_prompt, matched, tp, fp, fn, round(micro_p,6) AS micro_p, round(micro_r,6) AS micro_r, round(micro_f1,6) AS micro_f1, round(micro_f1-own,6) AS gain_over_matched
      FROM (SELECT *, max(CASE WHEN matched THEN micro_f1 END) OVER (PARTITION BY train_prompt) AS own FROM m)""",
      drawn="SELECT hadm_id, any_value(f_codes_str) AS f_codes_str FROM cohort GROUP BY 1 ORDER BY md5('42:'||hadm_id::varchar), hadm_id LIMIT 200",
      cell=f"SELECT * FROM (VALUES {cells}) v(train_prompt, step, eval_prompt, more)",
      found=f"""SELECT train_prompt, eval_prompt, hadm_id, list_distinct(flatten(list([{code.format(40)}, {code.format('step')}]))) AS p FROM (SELECT *, length(piece)+more AS n FROM ({_PIECES}) JOIN drawn USING (hadm_id), cell) GROUP BY ALL""",
      s="SELECT train_prompt, eval_prompt, len(p) AS np, len(a) AS na, len(list_intersect(a,p)) AS tp FROM (SELECT *, list_distinct(string_split(f_codes_str,', ')) AS a FROM found JOIN drawn USING (hadm_id))",
      m="""SELECT train_prompt, eval_prompt, train_prompt=eval_prompt AS matched, sum(tp)::bigint AS tp, sum(np-tp)::bigint AS fp, sum(na-tp)::bigint AS fn, sum(tp)*1.0::double/sum(np) AS micro_p, sum(tp)*1.0::double/sum(na) AS micro_r,
        2.0::double*sum(tp)/sum(np+na) AS micro_f1 FROM s GROUP BY ALL""")  # fmt: skip


def _term_sentences() -> str:
    split = r"string_split(regexp_replace(lower(text), '([.!?])\s+', '\1'||chr(1), 'g'), chr(1))"
    hit = lambda t: rf"regexp_matches({_LETTERS.format('s')}, {_s(rf"\b{t}\b")})::int"
    one = lambda name, terms: f"SELECT doc_id, '{name}' AS list, {'+'.join(hit(t) for t in sorted(set(terms)))} AS n FROM sent"
    return _with("", "SELECT doc_id, list, count(*)::bigint AS n_sentences, sum(n)::bigint AS n_terms FROM found WHERE n>0 GROUP BY 1,2",
      sent=f"SELECT doc_id, unnest({split}) AS s FROM documents", found=one("terms", TERMS) + " UNION ALL " + one("long_terms", LONG_TERMS))


def _enrichment(tail: str) -> str:
    return _with("enr tot", f"SELECT word, diag AS count_in_diagnostic, other AS count_in_other, (diag+other)::bigint AS total_count, {tail}")


def _permutation() -> str:
    names = [f"{c}{k}" for k, _ in _TUNED for c in ("tp", "fp", "fn")]
    diffs = []
    for i, (ka, a) in enumerate(_TUNED):
        for kb, b in _TUNED[i + 1 :]:
            x = [f"(t_{c}{ka}-w_{c}{ka}+w_{c}{kb})" for c in ("tp", "fp", "fn")]
            y = [f"(t_{c}{kb}-w_{c}{kb}+w_{c}{ka})" for c in ("tp", "fp", "fn")]
            diffs.append(f"SELECT iter, '{a}' AS strategy_a, '{b}' AS strategy_b, (2.0*{x[0]}/(2*{x[0]}+{x[1]}+{x[2]}) - 2.0*{y[0]}/(2*{y[0]}+{y[1]}+{y[2]}))::double AS diff FROM sums")
    wide = "SELECT sample_id, " + ", ".join(f"max({c}) FILTER (WHERE k={k})::int AS {c}{k}" for k, _ in _TUNED for c in ("tp", "fp", "fn")) + " FROM sc GROUP BY 1"
    rows = f"(SELECT iter, pos, wide.* EXCLUDE (sample_id) FROM wide JOIN pos USING (sample_id), (SELECT unnest(range(-1,{PERMUTATIONS})) AS iter))"
    sums = "SELECT iter, " + ", ".join(f"sum({n})::bigint AS t_{n}, coalesce(sum({n}) FILTER (WHERE iter>=0 AND x>>31=1),0)::bigint AS w_{n}" for n in names) + f" FROM {_drawn(rows, 42, 'iter', 'pos')} GROUP BY 1"
    tests = f"""SELECT d.strategy_a, d.strategy_b, max(o.diff) AS diff, (count(*) FILTER (WHERE abs(d.diff)>=abs(o.diff))+1)/{PERMUTATIONS + 1}.0::double AS p_raw
      FROM diffs d JOIN diffs o USING (strategy_a, strategy_b) WHERE o.iter=-1 AND d.iter>=0 GROUP BY 1,2"""
    body = """SELECT strategy_a, strategy_b, round(diff,6) AS diff, round(p_raw,6)::double AS p_raw, round(least(1.0, max(adj) OVER (ORDER BY p_raw, strategy_a, strategy_b ROWS UNBOUNDED PRECEDING)),6)::double AS p_holm,
      least(1.0, max(adj) OVER (ORDER BY p_raw, strategy_a, strategy_b ROWS UNBOUNDED PRECEDING))<0.05 AS significant
      FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, strategy_a, strategy_b) + 1)*p_raw AS adj FROM tests)"""
    return _with("sc pos", body, wide=wide, sums=sums, diffs=" UNION ALL ".join(diffs), tests=tests)


def _draws(rows: str, key: str, seed: int, name: str) -> dict[str, str]:
    """Tables of positions and draws over ``rows``."""
    return {
        f"{name}p": f"SELECT *, row_number() OVER (ORDER BY ('0x'||substr(md5({key}::varchar),1,2))::int, {key})-1 AS pos FROM {rows}",
        f"{name}d": _boot_draws(f"(SELECT count(*) AS n FROM {name}p)", GAP_DRAWS, seed),
    }


def _cluster() -> str:
    per = "SELECT subject_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sc JOIN pat USING (sample_id) WHERE strategy='CoT' GROUP BY 1"
    f1 = "SELECT iter, (2.0*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)))::double AS f1 FROM cd JOIN cp USING (pos) GROUP BY 1"
    return _with("sc pat", "SELECT round(lo,6) AS ci_lo, round(hi,6) AS ci_hi FROM (SELECT " + _QUANT.format("f1") + " FROM f)", per=per, **_draws("per", "subject_id", 42, "c"), f=f1)


def _gap() -> str:
    rows = "SELECT sample_id, tp, fp, fn, known FROM sc JOIN pat USING (sample_id) WHERE strategy='CoT'"
    sums = {g: f"coalesce(2.0*sum(tp) FILTER (WHERE {on})/nullif(sum({_WORST}) FILTER (WHERE {on}),0),0)::double" for g, on in (("i", "known"), ("o", "NOT known"), ("f", "true"))}
    f = f"SELECT iter, {sums['i']}-{sums['o']} AS a, {sums['f']}-{sums['o']} AS b FROM gd JOIN gp USING (pos) GROUP BY 1"
    one = lambda g, c: f"SELECT '{g}' AS gap, round(quantile_cont({c},0.025),6) AS ci_lo, round(quantile_cont({c},0.975),6) AS ci_hi FROM f"
    return _with("sc pat", one("overlap_minus_disjoint", "a") + " UNION ALL " + one("full_minus_disjoint", "b"), r=rows, **_draws("r", "sample_id", 42, "g"), f=f)


def _sensitivity() -> str:
    rows = f"SELECT sample_id, tp, fp, fn, greatest(ceil((n-{OVERLAP})/{SIZE - OVERLAP}.0),1)>1 AS multi FROM sc JOIN tok ON doc_id=sample_id WHERE strategy='CoT'"
    extra = {"r": rows, "rs": "SELECT * FROM r WHERE NOT multi", "rm": "SELECT * FROM r WHERE multi"} | _draws("rs", "sample_id", 42, "s") | _draws("rm", "sample_id", 43, "m")
    f1 = f"(2.0*sum(tp)/nullif(sum({_WORST}),0))::double"
    extra |= {"fs": f"SELECT iter, {f1} AS f FROM sd JOIN sp USING (pos) GROUP BY 1", "fm": f"SELECT iter, {f1} AS f FROM md JOIN mp USING (pos) GROUP BY 1"}
    extra["q"] = "SELECT quantile_cont(fs.f-fm.f,0.025) AS lo, quantile_cont(fs.f-fm.f,0.975) AS hi FROM fs JOIN fm USING (iter)"
    part = lambda on: f"(2.0*sum(tp) FILTER (WHERE {on})/sum({_WORST}) FILTER (WHERE {on}))::double"
    body = f"""SELECT count(*) FILTER (WHERE NOT multi)::bigint AS n_single, count(*) FILTER (WHERE multi)::bigint AS n_multi, round({part('NOT multi')},6) AS f1_single, round({part('multi')},6) AS f1_multi,
      round({part('NOT multi')}-{part('multi')},6) AS gap, round(max(lo),6) AS ci_lo, round(max(hi),6) AS ci_hi FROM r, q"""
    return _with("sc tok", body, **extra)


def _errors(columns: str, tail: str) -> str:
    kind = "CASE WHEN f1=1.0 THEN 'perfect_match' WHEN f1>0 THEN 'partial_match' WHEN tp+fn=0 AND tp+fp>0 THEN 'false_positive_only' ELSE 'complete_miss' END"
    return _with("scf", columns, e=f"SELECT *, {kind} AS category FROM scf") if not tail else _with("scf arr", tail, e=f"SELECT *, {kind} AS category FROM scf")


ORACLES: dict[str, str] = {
    "cohort_build": _with("cohort", "SELECT * EXCLUDE (text) FROM cohort"),
    "diagnosis_groups": _with("lab", "SELECT * FROM lab"),
    "conflict_filter": _with("inst", """SELECT hadm_id, CASE WHEN bool_or(f_code LIKE 'F32%') AND bool_or(f_code LIKE 'F33%') THEN 'depression_temporal' ELSE 'bipolar_temporal' END AS conflict_type FROM inst
      GROUP BY 1 HAVING (bool_or(f_code LIKE 'F32%') AND bool_or(f_code LIKE 'F33%')) OR (bool_or(f_code LIKE 'F30%') AND bool_or(f_code LIKE 'F31%'))"""),
    "conflict_free": _with("inst", """SELECT hadm_id, count(*)::bigint AS f_code_count FROM inst GROUP BY 1
      HAVING NOT ((bool_or(f_code LIKE 'F32%') AND bool_or(f_code LIKE 'F33%')) OR (bool_or(f_code LIKE 'F30%') AND bool_or(f_code LIKE 'F31%')))"""),
    "cohort_stats": _with("cohort", """SELECT count(*)::bigint AS n_encounters, count(DISTINCT subject_id)::bigint AS n_patients, count(DISTINCT primary_f_code)::bigint AS n_primary_codes, sum(f_code_count)::bigint AS n_code_instances,
      round(avg(f_code_count),6) AS avg_codes, (SELECT count(*) FROM notes)::bigint AS n_notes, round(count(*)*100.0/(SELECT count(*) FROM notes),6)::double AS merge_pct FROM cohort"""),
    "stratified_split": _with("split", "SELECT hadm_id, primary_category, split FROM split"),
    "split_quality": _with("split", """SELECT split, count(*)::bigint AS n_rows, count(*) FILTER (WHERE subject_id IS NULL)::bigint AS n_null_keys, (count(*)-count(DISTINCT hadm_id))::bigint AS n_dup_hadm,
      count(*) FILTER (WHERE len(list_filter(string_split(f_codes_str, ', '), lambda c: length(c)>3 AND NOT contains(c,'.')))>0)::bigint AS n_bad_format, count(*) FILTER (WHERE f_codes_str='')::bigint AS n_empty,
      round(count(*)*100.0/(SELECT count(*) FROM split),6)::double AS pct FROM split GROUP BY 1"""),
    "split_overlap": _with("split", """SELECT count(*) FILTER (WHERE tr AND va)::bigint AS train_val, count(*) FILTER (WHERE tr AND te)::bigint AS train_test, count(*) FILTER (WHERE va AND te)::bigint AS val_test
      FROM (SELECT subject_id, bool_or(split='train') AS tr, bool_or(split='val') AS va, bool_or(split='test') AS te FROM split GROUP BY 1)"""),
    "split_topk_drift": _with("split", "SELECT split, top, top=(SELECT top FROM t WHERE split='train') AS same_as_train FROM t", t="""SELECT split, string_agg(primary_category, ',' ORDER BY primary_category) AS top
      FROM (SELECT split, primary_category, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, primary_category) AS r FROM split GROUP BY 1,2) WHERE r<=10 GROUP BY 1"""),
    "patient_overlap": _with("split", """SELECT count(*) FILTER (WHERE tr>0 AND va>0)::bigint AS train_val, count(*) FILTER (WHERE tr>0 AND te>0)::bigint AS train_test, count(*) FILTER (WHERE va>0 AND te>0)::bigint AS val_test,
      coalesce(sum(te) FILTER (WHERE tr>0),0)::bigint AS n_test_enc_in_train, round(coalesce(sum(te) FILTER (WHERE tr>0),0)*100.0/sum(te),6)::double AS pct_test_enc_in_train, count(*) FILTER (WHERE n>1)::bigint AS n_multi,
      round(count(*) FILTER (WHERE n>1)*100.0/count(*),6)::double AS pct_multi, round(avg(n),6) AS mean_enc, round(quantile_cont(n,0.5),6)::double AS median_enc, max(n)::bigint AS max_enc
      FROM (SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE split='train') AS tr, count(*) FILTER (WHERE split='val') AS va, count(*) FILTER (WHERE split='test') AS te FROM split GROUP BY 1)"""),
    "apportioned_split": _with("lab", """SELECT * FROM (WITH s AS (SELECT primary_category AS c, count(*)::bigint AS n FROM lab GROUP BY 1),
      a AS (SELECT c, n, n*70//100 AS low, row_number() OVER (ORDER BY n*70%100 DESC, c) AS r FROM s), b AS (SELECT c, n, low + (r <= (SELECT sum(n)*70//100-sum(low) FROM a))::int AS train FROM a),
      d AS (SELECT c, train, n-train AS m, (n-train)*15//30 AS low, row_number() OVER (ORDER BY (n-train)*15%30 DESC, c) AS r FROM b), e AS (SELECT c, train, low + (r <= (SELECT sum(m)*15//30-sum(low) FROM d))::int AS val FROM d)
      SELECT hadm_id, primary_category, CASE WHEN rn<=train THEN 'train' WHEN rn<=train+val THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY md5('42:'||hadm_id::varchar), hadm_id) AS rn FROM lab) l JOIN e ON l.primary_category=e.c)"""),
    "fixed_sample": _with("lab", "SELECT hadm_id, f_codes_str FROM lab ORDER BY md5('42:'||hadm_id::varchar), hadm_id LIMIT 1000"),
    "label_frequency": _with("freq", "SELECT * FROM freq"),
    "label_coverage": _with("cov", "SELECT rank, f_code, n, round(n*100.0/total,6)::double AS pct_of_instances, round(cum*100.0/total,6)::double AS cumulative_pct FROM cov"),
    "coverage_cutoff": _with("scov", """SELECT split, max(total)::bigint AS n_instances, count(*)::bigint AS n_codes, coalesce(min(rank) FILTER (WHERE cum*100>=90*total), max(rank))::bigint AS rank_at_90,
      round(max(cum*100.0/total) FILTER (WHERE rank<=42),6)::double AS coverage_at_42 FROM scov GROUP BY 1"""),
    "coverage_prefix": _with("cov", "SELECT rank, f_code, n FROM cov WHERE (cum-n)*100<total*90"),
    "coverage_at_k": _with("cov", "SELECT k::bigint AS k, round(max(cum*100.0/total),6)::double AS cumulative_pct FROM cov, (SELECT unnest([3,5,10,20,50]) AS k) WHERE rank<=k GROUP BY 1"),
    "split_stability": _with("scov", """SELECT count(*) FILTER (WHERE a AND b)::bigint AS common, coalesce(string_agg(f_code, ',' ORDER BY f_code) FILTER (WHERE a AND NOT b),'') AS only_train,
      coalesce(string_agg(f_code, ',' ORDER BY f_code) FILTER (WHERE b AND NOT a),'') AS only_test FROM (SELECT f_code, bool_or(split='train') AS a, bool_or(split='test') AS b FROM scov WHERE rank<=42 AND split IN ('train','test') GROUP BY 1)"""),
    "missing_labels": _with("sfreq", "SELECT f_code, n FROM sfreq WHERE split='train' AND f_code NOT IN (SELECT f_code FROM sfreq WHERE split='test')"),
    "labels_per_note": _with("lab", "SELECT round(avg(f_code_count),6) AS mean, round(stddev_pop(f_code_count),6) AS std_pop, round(quantile_cont(f_code_count,0.5),6)::double AS median, min(f_code_count)::bigint AS least, max(f_code_count)::bigint AS most FROM lab"),
    "text_length_stats": _with("tok", """SELECT round(avg(n),6) AS mean_words, round(quantile_cont(n,0.5),6)::double AS median_words, round(stddev_samp(n),6) AS std_words, min(n)::bigint AS min_words, max(n)::bigint AS max_words,
      round(avg(length(text)),6) AS mean_chars, count(*) FILTER (WHERE n>500)::bigint AS n_over_500 FROM tok"""),
    "text_percentiles": _with("tok", " UNION ALL ".join(f"SELECT {p}::bigint AS p, round(quantile_cont(n,{p / 100}),6)::double AS words FROM tok" for p in (25, 50, 75, 90, 95, 99))),
    "length_quantiles": _with("tok", " UNION ALL ".join(f"SELECT lang, {p}::bigint AS p, round(quantile_cont(n,{p / 100}),6)::double AS value FROM tok JOIN documents USING (doc_id) GROUP BY lang" for p in (5, 25, 50, 75, 95, 99))),
    "formatted_coverage": _with("cov", "SELECT f_code, format('{:,}', n*1000) AS thousands, format('{:,.2f}', n/8) AS eighths, format('{:.1f}', n*100.0/total)||'%' AS share FROM cov"),
    "label_cooccurrence": _with("inst cov", "SELECT x.f_code AS code_1, y.f_code AS code_2, count(*)::bigint AS n FROM t x JOIN t y USING (hadm_id) GROUP BY 1,2", t="SELECT DISTINCT hadm_id, f_code FROM inst WHERE f_code IN (SELECT f_code FROM cov WHERE rank<=10)"),
    "cooccurrence_pairs": _with("inst cov", """SELECT code_1, code_2, n, round(n*100.0/(SELECT count(*) FROM lab),6)::double AS pct_samples FROM (SELECT x.f_code AS code_1, y.f_code AS code_2, x.rank AS r1, y.rank AS r2, count(*)::bigint AS n
      FROM t x JOIN t y USING (hadm_id) WHERE x.rank<y.rank GROUP BY ALL) ORDER BY n DESC, r1, r2 LIMIT 15""", t="SELECT DISTINCT hadm_id, f_code, rank FROM inst JOIN cov USING (f_code) WHERE rank<=10"),
    "severity_rollup": _sev(),
    "rarity_buckets": _rarity(),
    "frequency_summary": _with("freq", "SELECT count(*)::bigint AS n_codes, round(avg(n),6) AS mean_n, list_sort(list(n))[count(*)//2+1]::bigint AS upper_median, count(*) FILTER (WHERE n=1)::bigint AS n_singletons FROM freq"),
    "chapter_rollup": _with("freq", f"SELECT {_case('substr(f_code,1,2)', CHAPTERS, 'neutral')} AS chapter, count(*)::bigint AS n_codes, sum(n)::bigint AS n_instances FROM freq GROUP BY 1"),
    "chunk_index": _with("chunks", "SELECT * EXCLUDE (text) FROM chunks"),
    "chunk_texts": _with("chunks", r"SELECT doc_id, chunk_idx, md5(CASE WHEN total_chunks=1 THEN text ELSE array_to_string(regexp_extract_all(text, '\S+')[start_token+1:end_token], ' ') END) AS input_md5 FROM chunks"),
    "chunk_stats": _with("chunks", """SELECT count(*)::bigint AS documents, sum(n)::bigint AS total_chunks, round(sum(n)/count(*)::double,6)::double AS chunks_per_doc, count(*) FILTER (WHERE n=1)::bigint AS single_chunk_docs, count(*) FILTER (WHERE n>1)::bigint AS multi_chunk_docs,
      round(count(*) FILTER (WHERE n=1)*100.0/count(*),6)::double AS single_chunk_pct, round(count(*) FILTER (WHERE n>1)*100.0/count(*),6)::double AS multi_chunk_pct, max(n)::bigint AS max_chunks FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)"""),
    "chunk_distribution": _with("chunks", "SELECT n AS n_chunks, count(*)::bigint AS n_docs FROM (SELECT doc_id, count(*)::bigint AS n FROM chunks GROUP BY 1) GROUP BY 1"),
    "chunk_label_inflation": _with("inst notes chunks", """SELECT f_code, count(*)::bigint AS n_docs, sum(k)::bigint AS n_chunks, round(sum(k)/count(*)::double,6)::double AS ratio FROM inst JOIN notes USING (hadm_id)
      JOIN (SELECT doc_id AS hadm_id, count(*) AS k FROM chunks GROUP BY 1) USING (hadm_id) GROUP BY 1"""),
    "section_positions": _sections(),
    "keyword_extract": _extract(),
    "extraction_methods": "SELECT extraction_method, count(*)::bigint AS n FROM (" + _extract() + ") GROUP BY 1",
    "term_doc_frequency": _with("termdf", "SELECT * FROM termdf"),
    "term_list_frequency": "SELECT unnest([" + _list(LONG_TERMS) + "]) AS term, unnest([" + ", ".join(rf"count(*) FILTER (WHERE regexp_matches(t, {_s(chr(92) + 'b' + x + chr(92) + 'b')}))" for x in LONG_TERMS) + rf"]) AS n_docs FROM (SELECT {_LETTERS.format('lower(text)')} AS t FROM documents)",
    "mined_term_frequency": r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), p AS (SELECT w, unnest(range(1, len(w)+1)) AS i FROM w),
      terms AS (SELECT w[i] AS term FROM p UNION SELECT w[i]||' '||w[i+1] FROM p WHERE i<len(w) AND w[i]<>w[i+1]),
      d AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+') AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT r, t, unnest(range(1, len(t)+1)) AS i FROM d),
      hits AS (SELECT r, t[i] AS term FROM x UNION ALL SELECT r, t[i]||' '||t[i+2] FROM x WHERE t[i+1]=' ' AND i+2<=len(t))
      SELECT term, count(DISTINCT r)::bigint AS n_docs, count(r)::bigint AS n_occurrences FROM terms LEFT JOIN hits USING (term) GROUP BY 1""",
    "top_percent_terms": _with("termdf", "SELECT * EXCLUDE (k) FROM (SELECT term, n_docs, row_number() OVER (ORDER BY n_docs DESC, term) AS rn, round_even(count(*) OVER ()*0.4,0) AS k FROM termdf) WHERE rn<=k"),
    "enrichment_ratio": _enrichment("CASE WHEN other=0 THEN 0.0 ELSE round((diag/ad)/(other/ao),6) END::double AS enrichment_ratio, other=0 AS is_infinite FROM enr, tot WHERE diag>0 AND diag+other>=5"),
    "enrichment_test_variant": _enrichment(f"round((diag/ad)/(greatest(other,1)/ao),6)::double AS enrichment_ratio FROM enr, tot WHERE diag>0 AND diag+other>=5 AND word NOT IN ({_list(TERMS)})"),
    "additional_terms": _with("enr tot", f"SELECT word, word IN ({_list(BRANDS)}) AS is_brand FROM enr, tot WHERE diag>0 AND diag+other>=5 AND (other=0 OR (diag/ad)/(other/ao)>=1.5) AND word NOT IN ({_list(sorted(set(TERMS) | noise_words()))})"),
    "header_mining": _with("hdrs", "SELECT * FROM hdrs"),
    "keyword_assembly": _with("cov termdf hdrs", "SELECT section, term FROM (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY o, term) AS r FROM x) WHERE r=1", x=f"""SELECT 0 AS o, 'codes' AS section, f_code AS term FROM cov WHERE (cum-n)*100<total*90
      UNION ALL SELECT 1, 'abbreviations', unnest([{_list(ABBREVIATIONS)}]) UNION ALL SELECT 2, 'indicators', unnest([{_list(INDICATORS)}])
      UNION ALL SELECT * FROM (SELECT 3, 'terms', term FROM termdf ORDER BY n_docs DESC, term LIMIT 3) UNION ALL SELECT * FROM (SELECT 4, 'headers', header FROM hdrs WHERE relevant ORDER BY n DESC, header LIMIT 16)"""),
    "term_overlap": _with("hdrs", """SELECT count(*) FILTER (WHERE f IS NOT NULL AND t IS NOT NULL)::bigint AS n_common, count(f)::bigint AS n_found, count(t)::bigint AS n_known, coalesce(string_agg(f, ',' ORDER BY f) FILTER (WHERE t IS NULL),'') AS only_found,
      coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE f IS NULL),'') AS only_known FROM (SELECT DISTINCT header AS f FROM (SELECT header FROM hdrs WHERE relevant ORDER BY n DESC, header LIMIT 16)) a
      FULL JOIN (SELECT unnest(['social history','medications on admission','plan']) AS t) b ON f=t"""),
    "sample_scores": _with("scf", "SELECT strategy, sample_id, tp, fp, fn, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, perfect_match FROM scf"),
    "per_code_metrics": _with("pc", "SELECT strategy, f_code, occurrences, tp, fp, fn, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM pc"),
    "micro_macro": _with("scf mic pc", """SELECT s.*, round(micro_p,6) AS micro_p, round(micro_r,6) AS micro_r, round(micro_f1,6) AS micro_f1, m.* EXCLUDE (strategy) FROM
      (SELECT strategy, count(*)::bigint AS n_samples, round(avg(f1),6) AS sample_avg_f1, round(avg(perfect_match),6) AS perfect_rate, sum(perfect_match)::bigint AS n_perfect, count(*) FILTER (WHERE f1>0 AND f1<1)::bigint AS n_partial, count(*) FILTER (WHERE f1=0)::bigint AS n_zero FROM scf GROUP BY 1) s
      JOIN mic USING (strategy) JOIN (SELECT strategy, round(avg(precision),6) AS macro_p, round(avg(recall),6) AS macro_r, round(avg(f1),6) AS macro_f1_all, round(avg(f1) FILTER (WHERE occurrences>0),6) AS macro_f1_occ FROM pc GROUP BY 1) m USING (strategy)"""),
    "strategy_ranking": _with("mic strat", """SELECT strategy, k::int AS ord, fine_tuned, round(micro_f1,6) AS micro_f1, round(micro_p,6) AS micro_p, round(micro_r,6) AS micro_r, row_number() OVER (ORDER BY micro_f1 DESC, k) AS rank_f1, row_number() OVER (ORDER BY micro_p DESC, k) AS rank_p,
      row_number() OVER (ORDER BY micro_r DESC, k) AS rank_r, round(micro_f1-(SELECT micro_f1 FROM mic WHERE k=0),6) AS gain_over_base, row_number() OVER (ORDER BY micro_f1 DESC, k)=1 AS best FROM mic JOIN strat USING (strategy, k)"""),
    "strategy_comparison": _with("scf mic pc strat", """SELECT strategy, k::int AS ord, CASE WHEN fine_tuned THEN 'Yes' ELSE 'No' END AS fine_tuned, round(micro_p,6) AS micro_p, round(micro_r,6) AS micro_r, round(micro_f1,6) AS micro_f1, round(macro,6) AS macro_f1,
      round(perfect*100,1) AS perfect_pct, round((k*90+30)/60.0,6)::double AS minutes, samples, round((micro_f1-base)/base*100,6) AS gain_pct FROM mic JOIN strat USING (strategy, k) JOIN (SELECT strategy, avg(perfect_match) AS perfect, count(*)::bigint AS samples FROM scf GROUP BY 1) USING (strategy)
      JOIN (SELECT strategy, avg(f1) FILTER (WHERE occurrences>0) AS macro FROM pc GROUP BY 1) USING (strategy), (SELECT micro_f1 AS base FROM mic WHERE k=0)"""),
    "aligned_strategies": _with("sc", """SELECT strategy, n AS n_samples, n AS n_shared, n=(SELECT count(*) FROM sc WHERE strategy='ZS') AS aligned FROM (SELECT strategy, count(*)::bigint AS n FROM sc WHERE strategy<>'KE' OR tp>0 GROUP BY 1)"""),
    "aligned_pairs": _with("sc", """SELECT * FROM (WITH part AS (SELECT strategy, sample_id FROM sc WHERE (strategy<>'KE' OR tp>0) AND (strategy<>'ZS' OR sample_id%7<>3)), n AS (SELECT strategy, count(*)::bigint AS n FROM part GROUP BY 1),
      meet AS (SELECT x.strategy AS a, y.strategy AS b, count(*) AS n FROM part x JOIN part y ON x.sample_id=y.sample_id AND x.strategy<y.strategy GROUP BY 1, 2)
      SELECT x.strategy AS strategy_a, y.strategy AS strategy_b, x.n AS n_a, y.n AS n_b, x.n=y.n AND x.n=coalesce(meet.n,0) AS aligned FROM n x JOIN n y ON x.strategy<y.strategy LEFT JOIN meet ON a=x.strategy AND b=y.strategy)"""),
    "best_strategy": _with("mic", "SELECT strategy, k::int AS ord, round(micro_f1,6) AS micro_f1 FROM mic ORDER BY mic.micro_f1 DESC, k LIMIT 1"),
    "category_metrics": _with("ev strat", """SELECT strategy, category, tp, fp, fn, round(CASE WHEN tp+fp=0 THEN 0 ELSE tp::double/(tp+fp) END,6)::double AS precision, round(CASE WHEN tp+fn=0 THEN 0 ELSE tp::double/(tp+fn) END,6)::double AS recall,
      round(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2.0*tp/(2*tp+fp+fn) END,6)::double AS f1 FROM (SELECT s.strategy, c.category, count(*) FILTER (WHERE a AND p)::bigint AS tp, count(*) FILTER (WHERE p AND NOT a)::bigint AS fp, count(*) FILTER (WHERE a AND NOT p)::bigint AS fn
      FROM strat s CROSS JOIN (SELECT unnest([""" + _list(CATEGORIES) + f"""]) AS category) c LEFT JOIN (SELECT *, {_CATEGORY} AS category FROM ev WHERE a OR p) e ON e.strategy=s.strategy AND e.category=c.category GROUP BY 1,2)"""),
    "tier_quartiles": _with("pc ev", """SELECT strategy, tier, count(*)::bigint AS n_codes, count(*) FILTER (WHERE f1=0)::bigint AS n_zero, min(tf)::bigint AS freq_lo, max(tf)::bigint AS freq_hi, round(min(f1),6) AS min_f1, round(quantile_cont(f1,0.25),6) AS q1, round(quantile_cont(f1,0.5),6) AS median_f1,
      round(quantile_cont(f1,0.75),6) AS q3, round(max(f1),6) AS max_f1 FROM (SELECT *, CASE WHEN rn<=floor(n*0.25) THEN 'frequent' WHEN rn<=floor(n*0.75) THEN 'moderate' ELSE 'rare' END AS tier FROM (SELECT pc.*, coalesce(t.n,0) AS tf, row_number() OVER (PARTITION BY strategy ORDER BY coalesce(t.n,0) DESC, f_code) AS rn,
      count(*) OVER (PARTITION BY strategy) AS n FROM pc LEFT JOIN (SELECT code AS f_code, count(*) AS n FROM ev WHERE strategy='ZS' AND a GROUP BY 1) t USING (f_code) WHERE occurrences>0)) GROUP BY 1,2"""),
    "frequency_tiers": _with("pc", """SELECT strategy, tier, count(*)::bigint AS num_codes, sum(occurrences)::bigint AS total_occurrences, round(avg(f1),6) AS mean_f1, count(*) FILTER (WHERE f1=0)::bigint AS num_zero_f1, coalesce(string_agg(f_code, ',' ORDER BY f_code) FILTER (WHERE f1=0),'') AS zero_f1_codes,
      round(CASE WHEN sum(tp+fp)=0 THEN 0 ELSE sum(tp)::double/sum(tp+fp) END,6)::double AS micro_p, round(CASE WHEN sum(tp+fn)=0 THEN 0 ELSE sum(tp)::double/sum(tp+fn) END,6)::double AS micro_r, round(CASE WHEN sum(2*tp+fp+fn)=0 THEN 0 ELSE 2.0*sum(tp)/sum(2*tp+fp+fn) END,6)::double AS micro_f1
      FROM (SELECT *, CASE WHEN occurrences BETWEEN 1 AND 5 THEN '1-5' WHEN occurrences BETWEEN 6 AND 20 THEN '6-20' WHEN occurrences BETWEEN 21 AND 100 THEN '21-100' ELSE '>100' END AS tier FROM pc WHERE occurrences>0) GROUP BY 1,2"""),
    "best_worst_codes": _with("pc", """SELECT strategy, f_code, round(f1,6) AS f1, occurrences, rank_best, rank_worst FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY f1 DESC, f_code) AS rank_best, row_number() OVER (PARTITION BY strategy ORDER BY f1, f_code) AS rank_worst FROM pc WHERE occurrences>=5)
      WHERE rank_best<=10 OR rank_worst<=10"""),
    "frequency_regression": _with("pc", "SELECT strategy, round(regr_slope(f1, log10(occurrences+1)),6) AS slope, round(regr_intercept(f1, log10(occurrences+1)),6) AS intercept FROM pc GROUP BY 1"),
    "f1_histogram": _with("pc", "SELECT coalesce(least(floor((f1-lo)*20.0/nullif(hi-lo,0)),19),0)::bigint AS bin, count(*)::bigint AS n FROM pc, (SELECT min(f1) AS lo, max(f1) AS hi FROM pc WHERE strategy='CoT') WHERE strategy='CoT' GROUP BY 1"),
    "error_categories": _errors("""SELECT s.strategy, c.category, count(e.category)::bigint AS n, round(count(e.category)*100.0/max(t),6)::double AS pct FROM (SELECT strategy, count(*) AS t FROM e GROUP BY 1) s
      CROSS JOIN (SELECT unnest(['perfect_match','partial_match','complete_miss','false_positive_only']) AS category) c LEFT JOIN e ON e.strategy=s.strategy AND e.category=c.category GROUP BY 1,2""", ""),
    "error_samples": _errors("", """SELECT e.strategy, category, rn, e.sample_id, coalesce(array_to_string(ac,'; '),'') AS actual_codes, coalesce(array_to_string(pcodes,'; '),'') AS predicted_codes
      FROM (SELECT *, row_number() OVER (PARTITION BY strategy, category ORDER BY sample_id) AS rn FROM e) e JOIN arr ON arr.strategy=e.strategy AND arr.sample_id=e.sample_id WHERE rn<=50"""),
    "fp_counts": _with("ev", "SELECT strategy, code AS f_code, count(*)::bigint AS n, round(count(*)*100.0/(SELECT count(DISTINCT sample_id) FROM ev),6)::double AS pct_samples FROM ev WHERE p AND NOT a GROUP BY 1,2"),
    "fn_counts": _with("ev", "SELECT strategy, code AS f_code, count(*)::bigint AS n, round(count(*)*100.0/(SELECT count(DISTINCT sample_id) FROM ev),6)::double AS pct_samples FROM ev WHERE a AND NOT p GROUP BY 1,2"),
    "fp_rows": _with("ev arr", "SELECT ev.strategy, ev.sample_id, code AS f_code, coalesce(array_to_string(ac,'; '),'') AS actual_codes, coalesce(array_to_string(pcodes,'; '),'') AS predicted_codes FROM ev JOIN arr ON arr.strategy=ev.strategy AND arr.sample_id=ev.sample_id WHERE p AND NOT a"),
    "fn_rows": _with("ev arr", "SELECT ev.strategy, ev.sample_id, code AS f_code, coalesce(array_to_string(ac,'; '),'') AS actual_codes, coalesce(array_to_string(pcodes,'; '),'') AS predicted_codes FROM ev JOIN arr ON arr.strategy=ev.strategy AND arr.sample_id=ev.sample_id WHERE a AND NOT p"),
    "most_frequent_codes": _with("pc", "SELECT f_code, occurrences, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM pc WHERE strategy='CoT' ORDER BY occurrences DESC, f_code LIMIT 20"),
    "confusion_pairs": _with("ev", "SELECT m.strategy, m.code AS actual, w.code AS predicted_instead, count(*)::bigint AS n FROM ev m JOIN ev w ON m.strategy=w.strategy AND m.sample_id=w.sample_id WHERE m.a AND NOT m.p AND w.p AND NOT w.a GROUP BY 1,2,3 HAVING count(*)>=2"),
    "fp_cooccurrence_matrix": _with("ev", "SELECT x.strategy, x.code AS actual, y.code AS other, count(*)::bigint AS n FROM t x JOIN t y ON x.strategy=y.strategy AND x.sample_id=y.sample_id WHERE x.a AND ((x.code=y.code AND x.p) OR (x.code<>y.code AND y.p AND NOT y.a)) GROUP BY 1,2,3",
      t="SELECT ev.* FROM ev JOIN (SELECT strategy, code, row_number() OVER (PARTITION BY strategy ORDER BY count(*) DESC, code) AS r FROM ev WHERE a GROUP BY 1,2) USING (strategy, code) WHERE r<=10"),
    "multi_hot_metrics": _with("ev", """SELECT strategy, round(sum(tp)::double/sum(tp+fp),6) AS micro_p, round(sum(tp)::double/sum(tp+fn),6) AS micro_r, round(2.0*sum(tp)/sum(2*tp+fp+fn),6)::double AS micro_f1, round(avg((fp+fn=0)::int),6) AS exact_match FROM (SELECT strategy, sample_id,
      count(*) FILTER (WHERE a AND p AND v) AS tp, count(*) FILTER (WHERE p AND NOT a AND v) AS fp, count(*) FILTER (WHERE a AND NOT p AND v) AS fn FROM (SELECT *, code IN (SELECT code FROM voc) AS v FROM ev) GROUP BY 1,2) GROUP BY 1""",
      voc="SELECT DISTINCT code FROM ev WHERE strategy='ZS' AND a"),
    "disjoint_scores": _with("sc pat", """SELECT strategy, n_total, n_disjoint, n_overlap, round(f,6) AS f1_full, round(d,6) AS f1_disjoint, round(o,6) AS f1_overlap, round(ef,6) AS exact_full, round(ed,6) AS exact_disjoint, round(eo,6) AS exact_overlap, round(o-d,6) AS gap_overlap_minus_disjoint, round(f-d,6) AS gap_full_minus_disjoint FROM (SELECT strategy, count(*)::bigint AS n_total,
      count(*) FILTER (WHERE NOT known)::bigint AS n_disjoint, count(*) FILTER (WHERE known)::bigint AS n_overlap, (2.0*sum(tp)/sum(2*tp+fp+fn))::double AS f, coalesce(2.0*sum(tp) FILTER (WHERE NOT known)/nullif(sum(2*tp+fp+fn) FILTER (WHERE NOT known),0),0)::double AS d,
      coalesce(2.0*sum(tp) FILTER (WHERE known)/nullif(sum(2*tp+fp+fn) FILTER (WHERE known),0),0)::double AS o,
      avg((fp+fn=0)::int) AS ef, avg((fp+fn=0)::int) FILTER (WHERE NOT known) AS ed, avg((fp+fn=0)::int) FILTER (WHERE known) AS eo FROM sc JOIN pat USING (sample_id) GROUP BY 1)"""),
    "bootstrap_ci": _with("boot", " UNION ALL ".join(f"SELECT strategy, '{m}' AS metric, round(lo,6) AS ci_lo, round(hi,6) AS ci_hi FROM (SELECT strategy, " + _QUANT.format(f"{m}::double") + " FROM boot GROUP BY 1)" for m in ("f1", "precision", "recall", "exact_match"))),
    "paired_bootstrap": _with("boot", "SELECT strategy_a, strategy_b, round(lo,6) AS ci_lo, round(hi,6) AS ci_hi FROM (SELECT a.strategy AS strategy_a, b.strategy AS strategy_b, " + _QUANT.format("(a.f1-b.f1)::double") + " FROM boot a JOIN boot b ON a.iter=b.iter AND a.k<b.k WHERE a.k>=2 GROUP BY 1,2)"),
    "permutation_test": _permutation(),
    "holm_adjust": """WITH b AS (SELECT c_nationkey AS nation, sum(c_acctbal) AS s, count(c_acctbal) AS n FROM customer GROUP BY 1),
      d AS (SELECT nation, round(abs(s/n - (SELECT sum(s)/sum(n) FROM b)),4) AS distance FROM b),
      t AS (SELECT *, (count(*) OVER (ORDER BY distance DESC RANGE UNBOUNDED PRECEDING)+1)/((SELECT count(*) FROM d)+1.0::double) AS p FROM d),
      a AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, nation) + 1)*p AS adj FROM t)
      SELECT nation, distance, round(p,6) AS p_raw, round(least(1.0, max(adj) OVER w),6)::double AS p_holm, least(1.0, max(adj) OVER w)<0.05 AS significant FROM a WINDOW w AS (ORDER BY p, nation ROWS UNBOUNDED PRECEDING)""",
    "top_two": _with("mic", "SELECT max(strategy) FILTER (WHERE r=1) AS first, max(strategy) FILTER (WHERE r=2) AS second, round(max(micro_f1) FILTER (WHERE r=1)-max(micro_f1) FILTER (WHERE r=2),6) AS difference FROM (SELECT *, row_number() OVER (ORDER BY micro_f1 DESC, k) AS r FROM mic)"),
    "latex_table": _with("mic", "SELECT strategy, strategy" + "".join(f"||' & '||CASE WHEN rank() OVER (ORDER BY round({c},3) DESC)=1 THEN '\\textbf{{'||format('{{:.3f}}',round({c},3))||'}}' ELSE format('{{:.3f}}',round({c},3)) END" for c in ("micro_f1", "micro_p", "micro_r")) + "||' \\\\' AS latex FROM mic"),
    "checkpoint_selection": _with("mic", "SELECT 'checkpoint-'||(k*100+100)::varchar AS name, (k*100+100)::bigint AS step, round(micro_f1,6) AS micro_f1, row_number() OVER (ORDER BY mic.micro_f1 DESC, k)=1 AS is_best FROM mic WHERE k*100+100>=200"),
    "chunk_union": "SELECT l_orderkey, string_agg(DISTINCT 'F'||lpad((l_partkey%40)::varchar,2,'0'), '; ' ORDER BY 'F'||lpad((l_partkey%40)::varchar,2,'0')) AS codes, count(DISTINCT l_linenumber%2)::bigint AS num_chunks FROM lineitem GROUP BY 1",
    "chunk_usage": _with("chunks", """SELECT lang, count(*)::bigint AS n_docs, sum(n)::bigint AS total_chunks, round(avg(n),6) AS avg_chunks, count(*) FILTER (WHERE n>1)::bigint AS n_multi, round(count(*) FILTER (WHERE n>1)*100.0/count(*),6)::double AS multi_pct
      FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) JOIN documents USING (doc_id) GROUP BY 1"""),
    "label_vocabulary": _with("freq", "SELECT f_code, row_number() OVER (ORDER BY f_code)-1 AS label_id FROM freq"),
    "literal_list": _with("termdf", "SELECT (i//2)::bigint AS line, string_agg(chr(39)||term||chr(39), ', ' ORDER BY term) AS text FROM (SELECT term, row_number() OVER (ORDER BY term)-1 AS i FROM (SELECT term FROM termdf ORDER BY n_docs DESC, term LIMIT 5)) GROUP BY 1"),
    "evaluation": _with("cohort chunks", """SELECT 'CoT' AS strategy, sample_id, subject_id, num_chunks, true AS success, array_to_string(list_sort(p),'; ') AS predicted_codes, tp, len(p)-tp AS fp, len(a)-tp AS fn, round(2.0*tp/(len(a)+len(p)),6)::double AS f1
      FROM (SELECT *, len(list_intersect(a,p))::bigint AS tp FROM (SELECT hadm_id AS sample_id, any_value(subject_id) AS subject_id, count(*)::bigint AS num_chunks, list_distinct(string_split(any_value(f_codes_str),', ')) AS a, list_distinct(list('F'||lpad((length(piece)%40)::varchar,2,'0'))) AS p
      FROM (SELECT cohort.*, CASE WHEN total_chunks=1 THEN chunks.text ELSE array_to_string(regexp_extract_all(chunks.text, '\\S+')[start_token+1:end_token], ' ') END AS piece FROM cohort JOIN chunks ON doc_id=hadm_id) GROUP BY 1))"""),
    "evaluations": _evaluations(),
    "indexed_term_sentences": _term_sentences(),
    "prompt_factorial": _factorial(),
    "csv_round_trip": _with("notes", "SELECT CASE WHEN coalesce(length(text),0)>=1000 THEN 'long' ELSE 'short' END AS split, hadm_id::varchar AS hadm_id, subject_id::varchar AS subject_id, length(nullif(text,''))::bigint AS n_chars, md5(nullif(text,'')) AS text_md5 FROM notes"),
    "json_round_trip": _with("cohort chunks", """SELECT hadm_id, md5(CASE WHEN total_chunks=1 THEN chunks.text ELSE array_to_string(regexp_extract_all(chunks.text, '\\S+')[start_token+1:end_token], ' ') END) AS input_md5, '["'||replace(f_codes_str,', ','", "')||'"]' AS output, false AS has_window
      FROM cohort JOIN chunks ON doc_id=hadm_id"""),
    "report_round_trip": _with("scf arr pat", "SELECT s.sample_id, pat.subject_id, coalesce(array_to_string(ac,'; '),'') AS actual_codes, coalesce(array_to_string(pcodes,'; '),'') AS predicted_codes, tp, fp, fn, round(f1,6) AS f1 FROM scf s JOIN arr ON arr.strategy=s.strategy AND arr.sample_id=s.sample_id JOIN pat ON pat.sample_id=s.sample_id WHERE s.strategy='ZS' AND tp>0"),
    "term_file_round_trip": "SELECT unnest([" + _list(LONG_TERMS) + "]) AS term, unnest([" + ", ".join(rf"count(*) FILTER (WHERE regexp_matches(t, {_s(chr(92) + 'b' + x + chr(92) + 'b')}))" for x in LONG_TERMS) + "])::bigint AS count, unnest([" + ", ".join(str(int(" " in x)) for x in LONG_TERMS) + f"])::int AS is_phrase FROM (SELECT {_LETTERS.format('lower(text)')} AS t FROM documents)",
    "latest_report": _with("scf pat", "SELECT s.sample_id, tp, fp, fn, 'eval_b.json' AS run FROM scf s JOIN pat ON pat.sample_id=s.sample_id WHERE s.strategy='ZS' AND pat.subject_id IS NOT NULL"),
    "cluster_bootstrap": _cluster(),
    "gap_bootstrap": _gap(),
    "chunk_sensitivity": _sensitivity(),
    "parse_responses": _with("resp0", """SELECT sample_id, kind::bigint AS kind, array_to_string(x,'; ') AS codes, array_to_string(x,'; ') AS codes_checked, array_to_string(CASE WHEN kind IN (2,3,4) THEN y[1:5] ELSE c END,'; ') AS codes_checkpoint
      FROM (SELECT *, CASE WHEN kind=4 THEN list_distinct_keep ELSE c END AS x, CASE WHEN kind=4 THEN list_distinct_keep ELSE c END AS y FROM (SELECT *, CASE WHEN list_contains(c,'F99') THEN c ELSE list_append(c,'F99') END AS list_distinct_keep FROM resp0))"""),
    "parse_label_lists": _with("lab", """SELECT hadm_id, replace(f_codes_str,', ','|') AS v1, replace(f_codes_str,', ','|') AS v2, replace(f_codes_str,', ','|') AS v3, replace(f_codes_str,', ','|') AS v4, replace(f_codes_str,', ','|') AS v5, replace(f_codes_str,', ','|') AS v6,
      '["'||replace(f_codes_str,', ','", "')||'"]' AS json FROM lab"""),
    "instruction_rows": _with("cohort chunks", "SELECT count(*)::bigint AS n_rows, count(*) FILTER (WHERE chunks.text IS NULL)::bigint AS n_null_input, 0::bigint AS n_bad_output FROM cohort JOIN chunks ON doc_id=hadm_id"),
    "chat_messages": "SELECT conv_id, count(*)::bigint AS n_turns, string_agg(role||':'||length(text)::varchar, ',' ORDER BY turn, role, text) AS shape FROM conversations GROUP BY 1",
    "training_chats": _with("cohort", "SELECT hadm_id, 3::bigint AS n_messages, md5('Discharge Summary:'||chr(10)||text) AS user_md5, '[\"'||replace(f_codes_str,', ','\", \"')||'\"]' AS answer FROM cohort"),
}
ORACLES["pairwise_comparison"] = f"""SELECT *, CASE WHEN p_holm<0.001 THEN '***' WHEN p_holm<0.01 THEN '**' WHEN p_holm<0.05 THEN '*' ELSE 'ns' END AS stars
  FROM ({ORACLES["paired_bootstrap"]}) b JOIN ({ORACLES["permutation_test"]}) p USING (strategy_a, strategy_b)"""
ORACLES["indexed_term_frequency"] = ORACLES["mined_term_frequency"]
