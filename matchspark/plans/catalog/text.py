"""Queries over report pages, captions, narration and written claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import text as TX
from matchspark.operators import narration as N
from matchspark.operators import windows as W
from matchspark.plans.registry import query

REACT = "(event_type = 'celebration' OR story_phase = 'reaction')"
PT = lambda h: f"regexp_replace(strip_accents(lower(regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g')"
TOKEN = lambda t: f"coalesce(([w FOR w IN string_split({t}, ' ') IF length(w) = list_max([length(x) FOR x IN string_split({t}, ' ') IF length(x) >= 3 AND x NOT IN ('afc', 'cf', 'city', 'fc', 'football', 'the', 'united')]) AND w NOT IN ('afc', 'cf', 'city', 'fc', 'football', 'the', 'united')])[1], '')"


@query("page_text", f"SELECT page_id, {PT('html')} AS text FROM pages")
def _(v):
    return v.parquet("pages").select("page_id", TX.page_text(F.col("html")).alias("text"))


@query("identity_token", f"""WITH t AS (SELECT doc_id, [w FOR w IN string_split({PT('text')}, ' ') IF length(w) >= 3 AND w NOT IN ('afc', 'cf', 'city', 'fc', 'football', 'the', 'united')] AS ws FROM documents),
  u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t), m AS (SELECT doc_id, arg_min(w, struct_pack(l := -length(w), i := i)) AS token FROM u GROUP BY doc_id) SELECT doc_id, coalesce(token, '') AS token FROM t LEFT JOIN m USING (doc_id)""")
def _(v):
    return v.parquet("documents").select("doc_id", TX.identity_token(F.col("text")).alias("token"))


CL = ["page_id AS claim_id", "page_id", "CASE WHEN page_id % 5 = 0 THEN 'Zzyzx Town' ELSE regexp_extract(html, '<p>[^A-Za-z]*([A-Za-z]+)', 1) END AS home", "'FC Reading' AS away", "CASE WHEN page_id % 3 = 0 THEN '2-1' ELSE '4 : 0' END AS score", "CASE WHEN page_id % 7 = 0 THEN 'Absentman' ELSE 'Reading' END AS scorer"]
HTML = "html || '<p>Reading' || CASE WHEN page_id % 2 = 0 THEN ' 2-1' ELSE ' 4:0' END || '</p>'"


@query("page_supports", f"""WITH p AS (SELECT page_id, ' ' || {PT(HTML)} || ' ' AS t FROM pages), c AS (SELECT {', '.join(CL)} FROM pages), k AS (SELECT c.*, t, {TOKEN(PT('home'))} AS h FROM c JOIN p USING (page_id))
  SELECT claim_id, page_id, h <> '' AND contains(t, ' ' || h || ' ') AND contains(t, ' reading ') AND contains(t, CASE WHEN score = '2-1' THEN ' 2 1 ' ELSE ' 4 0 ' END) AND (scorer = 'Reading' OR contains(t, ' absentman ')) AS supported FROM k""")
def _(v):
    pages = v.parquet("pages")
    claims = pages.selectExpr(*CL).withColumn("scorers", F.array("scorer"))
    return TX.page_supports(claims, pages.selectExpr("page_id", f"{HTML} AS html"))


@query("trusted_pages", r"""SELECT page_id FROM pages WHERE url LIKE 'https://%' AND NOT regexp_matches(url, '^https://[^/?#]*@') AND NOT regexp_matches(url, '^https://[^/?#]*:[0-9]+') AND regexp_matches(regexp_replace(lower(regexp_extract(url, '^https://([^/?#]+)', 1)), '^www\.', ''), '(^|\.)example\.(net|org)$')""")
def _(v):
    return TX.trusted_pages(v.parquet("pages"), ["example.net", "example.org"]).select("page_id")


VC = ["match_id", "CASE WHEN match_id % 9 = 0 THEN 0.8e0 ELSE 0.95e0 END AS confidence", "'Red Town' AS home", "'Blue City' AS away", "concat(CAST(match_id % 2 + 1 AS STRING), CASE WHEN match_id % 3 = 0 THEN '–' ELSE ' - ' END, '1') AS score", "match_id % 2 + 2 AS goal_count"]
VG = ["match_id", "CASE WHEN match_id % 11 = 4 AND i = 0 THEN ' ' ELSE 'Someone' END AS scorer", "CASE WHEN i = 2 THEN 'BLUE-city' WHEN match_id % 7 = 6 THEN 'Green' ELSE 'Red  Town' END AS team"]
VS = ["match_id", "concat('https://s', CAST(i AS STRING), '.org/', CAST(match_id AS STRING)) AS url"]


@query("verify_context", f"""WITH c AS (SELECT {', '.join(VC)} FROM sources_v), g AS (SELECT {', '.join(VG)} FROM sources_v, (SELECT unnest([0, 1, 2]) AS i) WHERE i > 0 OR match_id % 2 = 1), s AS (SELECT match_id, count(DISTINCT url) AS n FROM (SELECT {', '.join(VS)} FROM sources_v, (SELECT unnest(range(3)) AS i) WHERE i < match_id % 4) GROUP BY match_id),
  p AS (SELECT match_id, count(*) AS n, count(*) FILTER (team LIKE 'Red%') AS nh, count(*) FILTER (team LIKE 'BLUE%') AS na FROM g WHERE trim(scorer) <> '' GROUP BY match_id),
  r AS (SELECT c.match_id, coalesce(s.n, 0) AS ns, confidence >= 0.9e0 AND coalesce(s.n, 0) >= 2 AND coalesce(p.n = goal_count AND match_id % 2 + 2 = goal_count AND nh = match_id % 2 + 1 AND na = 1 AND nh + na = p.n, false) AS ok FROM c LEFT JOIN p USING (match_id) LEFT JOIN s USING (match_id))
  SELECT match_id, CASE WHEN ok THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN ok THEN NULL WHEN ns < 2 THEN 'fewer_than_two_grounding_sources' ELSE 'fixture_or_goal_count_not_corroborated' END AS reason FROM r""")
def _(v):
    goals = v.sources.selectExpr("match_id", "explode(sequence(0, 2)) AS i").where("i > 0 OR match_id % 2 = 1").selectExpr(*VG)
    urls = v.sources.selectExpr("match_id", "explode(sequence(0, 2)) AS i").where("i < match_id % 4").selectExpr(*VS)
    return TX.verify_context(v.sources.selectExpr(*VC), goals, urls)


FN = "CASE k % 4 WHEN 0 THEN concat('match-', CAST(k AS STRING), '-28') WHEN 1 THEN concat('cup_Brentfjörd-', CAST(k % 20 AS STRING), '-0-Chelsea-full') WHEN 2 THEN concat('Hull City ', CAST(k % 9 AS STRING), ' ', CAST(k % 7 AS STRING), ' Leeds.mp4') ELSE concat('x-', CAST(k AS STRING), '-2-y') END"


@query("goal_total_from_name", f"SELECT event_id, CASE k % 4 WHEN 1 THEN CASE WHEN k % 20 <= 15 THEN k % 20 END WHEN 2 THEN k % 9 + k % 7 END AS goals FROM base_v")
def _(v):
    return v.base.select("event_id", TX.goal_total_from_name(F.expr(FN)).alias("goals"))


CAP = "CASE ordinal % 6 WHEN 0 THEN 'the big  chance' WHEN 1 THEN description WHEN 2 THEN 'inside from the' WHEN 3 THEN 'GOAL' WHEN 4 THEN concat('keeper {beats} ', event_type) ELSE NULL END"
ROLES = "CASE ordinal % 8 WHEN 0 THEN 'hook' WHEN 1 THEN 'setup' WHEN 2 THEN 'turn' WHEN 3 THEN 'conclusion' WHEN 4 THEN 'evidence' WHEN 5 THEN 'odd' WHEN 6 THEN NULL ELSE 'analysis' END"
CAP_SQL = r"""cp AS (SELECT *, upper(trim(regexp_replace(regexp_replace(coalesce(c, ''), '[{}\\\r\n]', ' ', 'g'), '\s+', ' ', 'g'))) AS t FROM (SELECT moment_id, match_id, ordinal, """ + CAP + " AS c, " + ROLES + r""" AS r FROM moments_v)),
  cc AS (SELECT *, len(string_split(t, ' ')) BETWEEN 2 AND 4 AND length(t) <= 28 AND NOT regexp_matches(t, '\b(THE|A|AN|FROM|WITH|FOR|INTO|OF|AT|BY|AND|TO|IS|ARE)[.!?]*$') AS ok FROM cp),
  cf AS (SELECT *, CASE WHEN ok THEN t ELSE CASE coalesce(r, 'analysis') WHEN 'hook' THEN 'MATCH TURNING POINTS' WHEN 'setup' THEN 'THE OPENING MOVE' WHEN 'analysis' THEN 'WHY IT WORKED' WHEN 'evidence' THEN 'DECISIVE EVIDENCE' WHEN 'turn' THEN 'MOMENTUM SHIFTS' WHEN 'conclusion' THEN 'THE FINAL LESSON' ELSE 'THE KEY MOMENT' END END AS caption FROM cc)"""


@query("concise_caption", f"WITH {CAP_SQL} SELECT moment_id, caption FROM cf")
def _(v):
    return v.moments.select("moment_id", TX.concise_caption(F.expr(CAP), F.expr(ROLES)).alias("caption"))


SENT = lambda c: rf"CASE WHEN trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')) = '' OR regexp_matches(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')), '[.!?]$') THEN trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')) ELSE trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')) || '.' END"


@query("normalize_plan", f"""WITH {CAP_SQL}, s AS (SELECT *, {SENT('n')} AS s FROM (SELECT cf.*, CASE WHEN ordinal % 7 = 3 THEN '  ' ELSE commentary END AS n, CASE WHEN ordinal % 9 = 0 THEN NULL ELSE moment_id || '/x' END AS b FROM cf JOIN moments_v USING (match_id, moment_id, ordinal)))
  SELECT match_id, ordinal, CASE WHEN b IS NULL THEN 'beat-' || (ordinal + 1) ELSE replace(b, '/', '-') END AS beat_id, coalesce(r, 'analysis') AS role, s AS narration, caption, len(string_split(s, ' ')) AS words FROM s WHERE s <> ''""")
def _(v):
    rows = v.moments.selectExpr("match_id", "ordinal", "CASE WHEN ordinal % 9 = 0 THEN NULL ELSE concat(moment_id, '/x') END AS beat_id", f"{ROLES} AS role", "CASE WHEN ordinal % 7 = 3 THEN '  ' ELSE commentary END AS narration", f"{CAP} AS caption")
    return N.normalize_plan(rows)


@query("continuous_script", f"SELECT match_id, array_to_string(list({SENT('narration')} ORDER BY ordinal), ' ') AS script FROM beats_v WHERE trim(narration) <> '' GROUP BY match_id")
def _(v):
    return N.continuous_script(v.beats)


@query("team_key", "SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') AS key FROM documents")
def _(v):
    return v.parquet("documents").select("doc_id", TX.team_key(F.col("text")).alias("key"))


STEM = "CASE WHEN w LIKE 'clear%' THEN 'clearance' WHEN w LIKE 'cross%' THEN 'cross' WHEN w LIKE 'defen%' THEN 'defense' WHEN w LIKE 'attack%' THEN 'attack' WHEN w LIKE 'celebr%' THEN 'celebration' WHEN w LIKE 'dribbl%' THEN 'dribble' WHEN w LIKE 'finish%' THEN 'finish' WHEN w LIKE 'head%' THEN 'header' WHEN w LIKE 'sav%' THEN 'save' WHEN w LIKE 'shoot%' THEN 'shot' WHEN w LIKE 'tackl%' THEN 'tackle' WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, -1) ELSE w END"


@query("semantic_tokens", f"""SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN [{STEM} FOR w IN string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ')] IF length(x) >= 4 AND x NOT IN ({', '.join(repr(w) for w in TX.STOP_WORDS)})])), ' ') AS tokens FROM documents""")
def _(v):
    return v.parquet("documents").select("doc_id", F.array_join(F.array_sort(TX.semantic_tokens(F.col("text"))), " ").alias("tokens"))


# words of every turn, walked one by one
CHUNK_SQL = r"""WITH RECURSIVE ws AS MATERIALIZED (SELECT conv_id, turn, [w FOR w IN string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') IF w <> ''] AS ws FROM conversations),
  wk AS (SELECT conv_id, turn, ws, 0 AS i, []::VARCHAR[] AS done, '' AS cur, 0 AS n FROM ws UNION ALL
    SELECT conv_id, turn, ws, i + 1, CASE WHEN stop THEN list_append(d, c) ELSE d END, CASE WHEN stop THEN '' ELSE c END, CASE WHEN stop THEN 0 ELSE m END FROM (
     SELECT *, regexp_matches(ws[i + 1], '[.!?,;:]$') AND m >= 2 AS stop FROM (SELECT *, CASE WHEN full_up THEN list_append(done, cur) ELSE done END AS d, CASE WHEN full_up OR n = 0 THEN ws[i + 1] ELSE cur || ' ' || ws[i + 1] END AS c, CASE WHEN full_up THEN 1 ELSE n + 1 END AS m
       FROM (SELECT *, n > 0 AND (n >= 3 OR length(cur || ' ' || ws[i + 1]) > 18) AS full_up FROM wk WHERE i < len(ws))))),
  fn AS (SELECT * FROM wk WHERE i = len(ws)), o AS (SELECT conv_id, turn, CASE WHEN n = 0 THEN done WHEN n = 1 AND len(done) > 0 AND len(string_split(done[-1], ' ')) < 3 AND length(done[-1] || ' ' || cur) <= 18 THEN list_append(done[1:len(done) - 1], done[-1] || ' ' || cur) ELSE list_append(done, cur) END AS q FROM fn)
  SELECT conv_id, turn, array_to_string(q, ' / ') AS chunks FROM o"""


@query("caption_chunks", CHUNK_SQL)
def _(v):
    return v.parquet("conversations").select("conv_id", "turn", F.array_join(TX.caption_chunks(F.col("text")), " / ").alias("chunks"))


BYTES_SQL = r"""WITH RECURSIVE st AS (SELECT conv_id, turn, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM conversations),
  un AS MATERIALIZED (SELECT conv_id, turn, [u FOR u IN flatten([CASE WHEN strlen(s) <= 60 THEN [s] ELSE string_split(s, ' ') END FOR s IN ss]) IF u <> ''] AS us FROM st),
  wk AS (SELECT conv_id, turn, us, 0 AS i, []::VARCHAR[] AS done, '' AS cur FROM un UNION ALL SELECT conv_id, turn, us, i + 1, CASE WHEN strlen(l) > 60 THEN list_append(done, cur) ELSE done END, CASE WHEN strlen(l) > 60 THEN us[i + 1] ELSE l END
    FROM (SELECT *, CASE WHEN cur = '' THEN us[i + 1] ELSE cur || ' ' || us[i + 1] END AS l FROM wk WHERE i < len(us)))
  SELECT conv_id, turn, array_to_string(CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END, ' / ') AS chunks FROM wk WHERE i = len(us)"""


@query("byte_chunks", BYTES_SQL)
def _(v):
    return v.parquet("conversations").select("conv_id", "turn", F.array_join(TX.byte_chunks(F.col("text"), 60), " / ").alias("chunks"))


@query("subtitle_chunks")
def _(v):
    return TX.subtitle_chunks(v.beats.withColumn("length_ms", F.length("narration") * 60))


WB = ["match_id", "moment_id", "start_ms AS out_start_ms", "end_ms AS out_end_ms", "(ordinal % 60) / 10e0 AS rate"]


@query("word_budgets", f"""WITH b AS (SELECT {', '.join(WB)} FROM moments_v), r AS (SELECT *, CASE WHEN rate BETWEEN 0.8e0 AND 5 THEN rate ELSE 2.6e0 END AS r, (out_end_ms - out_start_ms) / 1000 AS s FROM b)
  SELECT moment_id, CAST(greatest(2, floor(s * r * 0.9e0 + 1e-9)) AS BIGINT) AS suggested, CAST(greatest(3, floor(s * r + 1e-9)) AS BIGINT) AS maximum FROM r""")
def _(v):
    return TX.word_budgets(v.moments.selectExpr(*WB), F.col("rate")).select("moment_id", "suggested", "maximum")


PLAN = ["conv_id", "turn", "CASE turn % 3 WHEN 0 THEN 'Five words make one title' WHEN 1 THEN 'Short one' ELSE NULL END AS title", "concat(text, CASE turn % 8 WHEN 0 THEN ' Watch this run.' WHEN 1 THEN ' He clips the post.' WHEN 2 THEN ' The replay shows it.' WHEN 3 THEN ' The moment unfolds.' WHEN 4 THEN ' He scored.' WHEN 5 THEN ' He pumps his fist.' WHEN 6 THEN ' That seals a late win.' ELSE '' END) AS script",
        "turn % 4 AS beats", "2 AS slots", "turn % 2 AS goal_count", "20 + turn % 30 AS target_s", "CASE WHEN turn % 5 <> 0 THEN 'x' END AS thesis", "'q' AS question", "'a' AS answer", "turn % 5 <> 2 AS complete", "turn % 2 = 0 AS auto", "CASE WHEN conv_id % 3 = 0 THEN 'verified' WHEN conv_id % 3 = 1 THEN 'open' END AS context_status"]


@query("plan_problems", rf"""WITH p AS (SELECT {', '.join(PLAN)} FROM conversations), w AS (SELECT *, len(string_split(trim(regexp_replace(script, '\s+', ' ', 'g')), ' ')) AS n, CASE WHEN title IS NULL THEN 0 ELSE len(string_split(title, ' ')) END AS tw FROM p)
  SELECT conv_id, turn, array_to_string([x FOR x IN [CASE WHEN complete AND tw NOT BETWEEN 5 AND 10 THEN 'recap_title_must_have_5_to_10_words' END, CASE WHEN n < floor(target_s * 2.55e0 + 0.5e0) THEN 'script_too_short' END, CASE WHEN n > floor(target_s * 2.85e0 + 0.5e0) THEN 'script_too_long' END,
    CASE WHEN auto AND turn % 9 = 4 THEN 'caption_must_be_complete_2_to_4_word_headline' END, CASE WHEN thesis IS NULL THEN 'missing_analysis_structure' END, CASE WHEN beats < slots THEN 'too_few_content_beats' END, CASE WHEN beats > slots THEN 'too_many_content_beats' END, CASE WHEN turn % 8 = 0 THEN 'directing_filler_language' END, CASE WHEN turn % 8 = 2 THEN 'recap_mentions_editing_or_replay' END,
    CASE WHEN complete AND turn % 8 = 3 THEN 'slow_documentary_filler' END, CASE WHEN complete AND turn % 8 = 5 THEN 'reaction_description_as_analysis' END, CASE WHEN complete AND turn % 8 = 6 AND conv_id % 3 <> 0 THEN 'unverified_match_outcome_claim' END, CASE WHEN goal_count = 0 AND turn % 8 = 4 THEN 'goal_claim_without_verified_live_action' END] IF x IS NOT NULL], ',') AS problems FROM w""")
def _(v):
    captions = F.when(F.col("turn") % 9 == 4, F.array(F.lit("LATE WINNER"), F.lit("ALONE"))).otherwise(F.array(F.lit("LATE WINNER")))
    return TX.plan_problems(v.parquet("conversations").selectExpr(*PLAN).withColumn("captions", captions)).select("conv_id", "turn", "problems")


IB = ["match_id", "concat('b', CAST(ordinal AS STRING)) AS beat_id", "story_id", "event_type = 'goal' AS goal_beat", "CASE ordinal % 4 WHEN 0 THEN 'A low shot by Ann O''Dea (9).' WHEN 1 THEN 'Bo-Lee waits' WHEN 2 THEN 'Anna O''Dea runs, bo-lee!' ELSE 'nobody' END AS narration", "CAST(NULL AS STRING) AS caption"]
INM = ["match_id", "CASE WHEN i = 0 THEN 'Ann O''Dea' ELSE 'Bo-Lee' END AS player", "CASE i WHEN 0 THEN 'scorer' WHEN 1 THEN 'assist' ELSE 'keeper' END AS role", "concat('s', CAST((match_id + i % 2) % 18 AS STRING)) AS story_id"]
ICX = ["match_id", "CASE WHEN match_id % 7 = 3 THEN 'pending' ELSE 'verified' END AS status", "CASE WHEN match_id % 5 = 2 THEN 2 ELSE 1 END AS goals"]


@query("identity_problems", f"""WITH b AS (SELECT {', '.join(IB)}, ordinal FROM moments_v), n AS (SELECT {', '.join(INM)} FROM sources_v, (SELECT unnest([0, 1, 2]) AS i)), c AS (SELECT {', '.join(ICX)} FROM sources_v),
  j AS (SELECT b.match_id, beat_id, player, bool_or(CASE WHEN player = 'Bo-Lee' THEN ordinal % 4 IN (1, 2) ELSE ordinal % 4 = 0 END) AS used, bool_or(n.story_id = b.story_id) AS own, bool_or(n.story_id = b.story_id AND role = 'scorer' AND goal_beat) AS due
    FROM b JOIN n USING (match_id) JOIN c USING (match_id) WHERE status = 'verified' AND goals = 1 GROUP BY ALL)
  SELECT match_id, beat_id, player, CASE WHEN used AND NOT own THEN 'wrong_incident' ELSE 'scorer_missing' END AS problem FROM j WHERE (used AND NOT own) OR (due AND NOT used) UNION ALL SELECT match_id, NULL, NULL, 'binding_incomplete' FROM c WHERE status = 'verified' AND goals <> 1""")
def _(v):
    names = v.sources.selectExpr("match_id", "explode(array(0, 1, 2)) AS i").selectExpr(*INM)
    return TX.identity_problems(v.moments.selectExpr(*IB), names, v.sources.selectExpr(*ICX))


UE = ["match_id", "ordinal AS entity_id", "CASE ordinal % 6 WHEN 0 THEN ' The Goal-Keeper ' WHEN 1 THEN 'the full-back' WHEN 2 THEN 'Red Town' WHEN 3 THEN 'Ann' WHEN 4 THEN 'a Winger' ELSE 'Visitors' END AS entity"]


@query("unverified_entities", "SELECT match_id, ordinal AS entity_id FROM moments_v WHERE ordinal % 6 = 0 OR ordinal % 6 = 2 AND match_id % 3 <> 0 OR ordinal % 6 = 3 AND match_id % 3 <> 1")
def _(v):
    names = v.sources.selectExpr("match_id", "CASE match_id % 3 WHEN 0 THEN 'RED town ' WHEN 1 THEN 'ann' ELSE 'x' END AS name")
    return TX.unverified_entities(v.moments.selectExpr(*UE), names).select("match_id", "entity_id")


SCL = ["match_id", "ordinal AS claim_id", "CASE ordinal % 4 WHEN 0 THEN '2–1' WHEN 1 THEN ' 2 : 1' WHEN 2 THEN '1-2' ELSE '2-1' END AS claim"]


@query("score_claims", "SELECT match_id, ordinal AS claim_id, match_id % 4 <> 3 AND ordinal % 4 <> 2 AND match_id % 5 <> 0 AS verified FROM moments_v")
def _(v):
    ctx = v.sources.where("match_id % 4 <> 3").selectExpr("match_id", "CASE WHEN match_id % 5 = 0 THEN 'unverified' ELSE 'verified' END AS status", "'2-1' AS final_score")
    return TX.score_claims(v.moments.selectExpr(*SCL), ctx).select("match_id", "claim_id", "verified")


OCL = ["match_id", "moment_id", "ordinal", "CASE ordinal % 5 WHEN 0 THEN 'The keeper SAVED it' WHEN 1 THEN 'He posts a chance' WHEN 2 THEN 'It stays 0 - 0 for now' WHEN 3 THEN 'A clear chance' ELSE 'Blocking run' END AS narration", "CASE WHEN ordinal % 10 = 3 THEN 'OFF THE CROSSBAR' END AS caption"]


@query("outcome_claims", "SELECT match_id, moment_id FROM moments_v WHERE ordinal % 3 = 0 AND (ordinal % 5 <> 3 OR ordinal % 10 = 3)")
def _(v):
    return TX.outcome_claims(v.moments.selectExpr(*OCL), v.moments.where("ordinal % 3 = 0")).select("match_id", "moment_id")


RE = ["match_id", "ordinal", "CASE match_id % 4 WHEN 0 THEN 'A late run, sealing the win.' WHEN 1 THEN 'They press. The save secured a famous victory!' WHEN 2 THEN 'They wait' ELSE 'A pass; clinches the result' END AS narration"]


@query("result_ending", """WITH l AS (SELECT match_id, max(ordinal) AS o FROM moments_v GROUP BY match_id)
  SELECT match_id, ordinal, CASE WHEN ordinal = o AND match_id % 7 <> 2 THEN CASE match_id % 4 WHEN 0 THEN 'A late run. The match ends 3-1.' WHEN 1 THEN 'They press. The match ends 3-1.' WHEN 2 THEN 'They wait' ELSE 'A pass. The match ends 3-1.' END
    ELSE CASE match_id % 4 WHEN 0 THEN 'A late run, sealing the win.' WHEN 1 THEN 'They press. The save secured a famous victory!' WHEN 2 THEN 'They wait' ELSE 'A pass; clinches the result' END END AS narration FROM moments_v JOIN l USING (match_id)""")
def _(v):
    ctx = v.sources.selectExpr("match_id", "CASE WHEN match_id % 7 = 2 THEN 'unverified' ELSE 'verified' END AS status", "'3 – 1' AS final_score")
    return TX.result_ending(v.moments.selectExpr(*RE), ctx)


NS = ["match_id", "ordinal AS slot", "story_id", "event_type", "start_ms AS out_start_ms", "end_ms AS out_end_ms", "description AS narration"]
COARSE = "concat('s', CAST(start_ms div 2700000 AS STRING))"


@query("narration_sections", f"""WITH n AS (SELECT {', '.join(NS)} FROM (SELECT * REPLACE ('s' || start_ms // 2700000 AS story_id, CASE WHEN ordinal % 3 = 0 THEN 'celebration' ELSE event_type END AS event_type) FROM moments_v)), o AS (SELECT *, CASE WHEN lag(story_id) OVER w = story_id AND event_type = 'celebration' THEN 0 ELSE 1 END AS op FROM n WINDOW w AS (PARTITION BY match_id ORDER BY slot)),
  s AS (SELECT *, CAST(sum(op) OVER (PARTITION BY match_id ORDER BY slot) AS BIGINT) AS section FROM o) SELECT match_id, section, count(*) AS scenes, min(out_start_ms) AS start_ms, arg_max(out_end_ms, slot) AS end_ms, array_to_string(list(trim(narration) ORDER BY slot), ' ') AS narration FROM s GROUP BY match_id, section""")
def _(v):
    rows = v.moments.withColumns(dict(story_id=F.expr(COARSE), event_type=F.expr("CASE WHEN ordinal % 3 = 0 THEN 'celebration' ELSE event_type END"))).selectExpr(*NS)
    return N.narration_sections(rows, F.floor(F.col("slot") / 2048))


LOCKED = "NOT (match_id % 5 = 2 AND ordinal % 40 = 1)"
MANIFEST = ["match_id", "moment_id", "ordinal AS position", "start_ms AS out_start_ms", "CASE WHEN match_id % 7 = 4 AND ordinal % 50 = 7 THEN start_ms ELSE end_ms END AS out_end_ms"]
MANIFEST_ROWS = "NOT (match_id % 5 = 3 AND ordinal % 40 = 1)"
EDIT = "5400000 + CASE WHEN match_id % 3 = 0 THEN 100000 ELSE 0 END AS edit_ms"


@query("locked_slots", f"""WITH m AS (SELECT match_id, moment_id FROM moments_v WHERE {LOCKED}), c0 AS (SELECT {', '.join(MANIFEST)} FROM moments_v WHERE {MANIFEST_ROWS}),
  c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE match_id % 11 = 5 AND position % 30 = 2), k AS (SELECT c.* FROM c SEMI JOIN m ON c.match_id = m.match_id AND c.moment_id = m.moment_id),
  o AS (SELECT *, lag(out_start_ms) OVER (PARTITION BY match_id ORDER BY position) AS prev FROM k),
  f AS (SELECT match_id, count(*) AS slots, count(DISTINCT moment_id) AS named, count(*) FILTER (out_end_ms <= out_start_ms OR out_start_ms < prev OR out_end_ms > 5400001 + CASE WHEN match_id % 3 = 0 THEN 100000 ELSE 0 END) AS bad FROM o GROUP BY match_id),
  s AS (SELECT match_id, count(*) AS scenes FROM m GROUP BY match_id)
  SELECT s.match_id, scenes, coalesce(slots, 0) AS slots, CASE WHEN coalesce(slots, 0) <> scenes OR coalesce(named, 0) <> scenes OR coalesce(bad, 0) > 0 THEN 'timing_disagrees' END AS violation FROM s LEFT JOIN f ON f.match_id = s.match_id""")
def _(v):
    man = v.moments.where(MANIFEST_ROWS).selectExpr(*MANIFEST)
    man = man.union(man.where("match_id % 11 = 5 AND position % 30 = 2"))
    return N.locked_slots(v.moments.where(LOCKED), man, v.sources.selectExpr("match_id", EDIT), F.floor(F.col("position") / 2048))


SC = ["match_id", "moment_id", "event_type", "story_phase", "CASE ordinal % 5 WHEN 0 THEN 'SAVED AT LAST' WHEN 1 THEN 'ONE TOUCH MORE' WHEN 2 THEN 'x' END AS caption", "end_ms - start_ms AS out_ms", "CASE WHEN ordinal % 3 <> 0 THEN 200 * (ordinal % 30) END AS window_start_ms", "200 * (ordinal % 30) + 1500 AS window_end_ms"]


@query("sparse_cues", f"""WITH s AS (SELECT {', '.join(SC)} FROM moments_v WHERE NOT {REACT}), a AS (SELECT *, CASE WHEN caption = 'SAVED AT LAST' THEN 'WATCH THE BUILDUP' WHEN caption = 'ONE TOUCH MORE' THEN caption ELSE CASE event_type WHEN 'goal' THEN 'THE DECISIVE TOUCH' WHEN 'save' THEN 'QUICK REACTIONS' WHEN 'big_chance' THEN 'A BIG CHANCE' WHEN 'shot_on_target' THEN 'TESTING THE KEEPER' ELSE 'SPACE OPENS UP' END END AS t,
    CAST(least(out_ms - 100, 120 + least(1500, floor(out_ms * 0.3e0))) AS BIGINT) AS fe, CASE event_type WHEN 'goal' THEN 'WHAT A FINISH' WHEN 'save' THEN 'DENIED BY THE KEEPER' WHEN 'big_chance' THEN 'SO CLOSE' WHEN 'shot_on_target' THEN 'ON TARGET' END AS p FROM s)
  SELECT match_id, moment_id, 'opening' AS cue, t AS text, 120::BIGINT AS start_ms, fe AS end_ms FROM a UNION ALL SELECT match_id, moment_id, 'payoff', p, window_start_ms, least(out_ms - 80, window_end_ms, window_start_ms + 1100) FROM a WHERE p IS NOT NULL AND window_start_ms >= fe + 300 AND window_start_ms < out_ms - 400""")
def _(v):
    return N.sparse_cues(v.moments.selectExpr(*SC))


RN = ["match_id", "moment_id", "CASE ordinal % 7 WHEN 0 THEN 'goal' WHEN 1 THEN 'keeper_save' WHEN 2 THEN 'woodwork' WHEN 3 THEN 'blocked' WHEN 4 THEN 'wide' WHEN 5 THEN 'over' ELSE 'uncertain' END AS outcome_type", "CASE WHEN ordinal % 3 <> 0 THEN event_type END AS reviewed_event"]


@query("reviewed_narration", f"""WITH r AS (SELECT {', '.join(RN)}, ordinal FROM moments_v WHERE ordinal % 3 <> 0 AND ordinal % 7 <> 6) SELECT match_id, moment_id, 'A pass opens space | ' || CASE WHEN ordinal % 2 = 0 THEN '' ELSE 'The runner waits | ' END || CASE ordinal % 7 WHEN 0 THEN 'The moving ball crosses the goal line inside the goal.' WHEN 1 THEN 'The goalkeeper visibly stops or deflects the shot.'
   WHEN 2 THEN 'The ball strikes the goal frame and stays out.' WHEN 3 THEN 'The attempt is blocked and the ball stays out.' WHEN 4 THEN 'The shot passes outside the goalpost.' ELSE 'The shot goes over the crossbar.' END AS facts FROM r""")
def _(v):
    rows = v.moments.selectExpr(*RN, "array('A pass opens space', CASE WHEN ordinal % 2 = 0 THEN 'He SCORED early' ELSE 'The runner waits' END) AS facts")
    return N.reviewed_narration(rows)


CW = ["match_id", "moment_id", "event_type", "start_ms", "end_ms", "CASE WHEN ordinal % 4 <> 0 THEN payoff_start_ms END AS payoff_start_ms", "CASE WHEN ordinal % 5 <> 0 THEN origin_ms END AS annotation_ms", "playback_rate", "freeze_ms", "2000 AS freeze_at_ms"]


@query("cue_windows", f"""WITH c AS (SELECT {', '.join(CW)} FROM moments_v), a AS (SELECT *, end_ms - start_ms AS n, event_type IN ('goal', 'shot_on_target', 'shot_off_target', 'save', 'big_chance') AS lt FROM c),
  b AS (SELECT *, CASE WHEN lt THEN coalesce(payoff_start_ms - start_ms, floor(n * 0.72e0)) ELSE coalesce(annotation_ms - start_ms, floor(n * 0.12e0)) END AS at0 FROM a), d AS (SELECT *, CAST(floor(least(greatest(80, n - 80), greatest(80, at0)) / playback_rate) AS BIGINT) AS o FROM b),
  e AS (SELECT *, CASE WHEN freeze_ms > 0 AND o >= 2000 THEN o + freeze_ms ELSE o END AS s FROM d) SELECT match_id, moment_id, s AS cue_start_ms, s + CASE WHEN event_type = 'goal' THEN 1250 ELSE 950 END AS cue_end_ms FROM e""")
def _(v):
    return N.cue_windows(v.moments.selectExpr(*CW))


RK = ["match_id", "scene_id", "CASE match_id % 3 WHEN 0 THEN 0.8e0 WHEN 1 THEN 1e0 ELSE 1.25e0 END AS rate", "CASE WHEN scene_id % 2 = 0 THEN 650 ELSE 0 END AS hold_ms", "1010 AS hold_at_ms"]


@query("retime_keyframes", f"""WITH s AS (SELECT {', '.join(RK)} FROM (SELECT DISTINCT match_id, scene_id FROM frames_v)), r AS (SELECT f.match_id, f.scene_id, frame, t_ms, camera_x, hold_ms, CAST(floor(t_ms / rate) AS BIGINT) AS o FROM frames_v f JOIN s USING (match_id, scene_id)),
  a AS (SELECT match_id, scene_id, hold_ms, arg_min(struct_pack(f := frame, c := camera_x), struct_pack(d := abs(o - 1010), t := t_ms)) AS a FROM r WHERE hold_ms > 0 GROUP BY ALL)
  SELECT match_id, scene_id, 'frame' AS kind, frame, CASE WHEN hold_ms > 0 AND o > 1010 THEN o + hold_ms ELSE o END AS o_ms, camera_x FROM r UNION ALL SELECT match_id, scene_id, 'hold_start', a.f, 1010, a.c FROM a UNION ALL SELECT match_id, scene_id, 'hold_end', a.f, 1010 + hold_ms, a.c FROM a""")
def _(v):
    scenes = v.frames.select("match_id", "scene_id").distinct().selectExpr(*RK)
    return N.retime_keyframes(v.frames.select("match_id", "scene_id", "frame", "t_ms", "camera_x"), scenes)


OBV = ["match_id", "moment_id", "ordinal * 10 + i AS ordinal", "CASE WHEN i < 2 THEN 'setup' ELSE 'payoff' END AS phase", "i // 2 AS o_ms", "CASE WHEN i % 2 = ordinal % 2 THEN 'ball moves' ELSE 'ball seen' END AS text"]


@query("writer_packet", f"""WITH i AS (SELECT match_id, 's' || match_id % 18 AS story_id, 'Ann' AS scorer FROM sources_v)
  SELECT m.match_id, moment_id, m.story_id, start_ms AS out_start_ms, end_ms AS out_end_ms, CAST(greatest(2, floor((end_ms - start_ms) / 1000 * 2.6e0 * 0.9e0 + 1e-9)) AS BIGINT) AS suggested, scorer,
   CASE WHEN ordinal % 4 = 0 THEN description WHEN ordinal % 2 = 0 THEN 'setup@ball moves; setup@ball seen; payoff@ball moves; payoff@ball seen' ELSE 'setup@ball seen; setup@ball moves; payoff@ball seen; payoff@ball moves' END AS evidence FROM moments_v m LEFT JOIN i ON i.match_id = m.match_id AND i.story_id = m.story_id""")
def _(v):
    slots = v.moments.selectExpr("match_id", "moment_id", "story_id", "start_ms AS out_start_ms", "end_ms AS out_end_ms", "description AS claim")
    one = v.moments.where("ordinal % 4 <> 0").selectExpr("match_id", "moment_id", "ordinal", "explode(sequence(0L, 3L)) AS i").selectExpr(*[c.replace("i // 2", "i div 2") for c in OBV])
    ids = v.sources.selectExpr("match_id", "concat('s', CAST(match_id % 18 AS STRING)) AS story_id", "'Ann' AS scorer")
    return N.writer_packet(slots, one.unionByName(one.withColumn("ordinal", F.col("ordinal") + 5)), ids)


@query("review_manifest", """WITH r AS (SELECT *, coalesce(edit_order, 0) AS ek, CAST(floor((end_ms - start_ms) / greatest(0.72e0, least(1e0, playback_rate))) AS BIGINT) + CASE WHEN effect = 'freeze_analysis' THEN greatest(400, least(1000, freeze_ms)) ELSE 0 END AS out_ms, greatest(40, least(360, transition_ms)) AS fade FROM moments_v WHERE selected),
  n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ek, ordinal) AS slot FROM r), c AS (SELECT *, sum(out_ms) OVER w - out_ms - sum(CASE WHEN slot > 1 THEN fade ELSE 0 END) OVER w AS s FROM n WINDOW w AS (PARTITION BY match_id ORDER BY slot ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, tracking_passed IS TRUE OR coalesce(regexp_matches(lower(tracking_decision), 'pass|verified|^planned_reaction$'), false) AS good FROM c)
  SELECT match_id, slot, moment_id, CAST(s AS BIGINT) AS out_start_ms, CAST(s + out_ms AS BIGINT) AS out_end_ms, CASE WHEN story_id = 's' || match_id % 18 THEN 'use_only_this_binding' ELSE 'role_only_no_player_name' END AS identity_policy, good AND event_type <> 'celebration' AS player_ring, good AND effect = 'freeze_analysis' AS freeze FROM g""")
def _(v):
    ids = v.sources.selectExpr("match_id", "concat('s', CAST(match_id % 18 AS STRING)) AS story_id", "'Ann' AS scorer")
    return N.review_manifest(v.moments.where("selected"), ids, F.floor(F.col("edit_key") / 4))
