"""Queries of the text operators: markup, scenes, sentences, number words, rules, chunks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from skald import dimensions as D
from skald.functions import text as X
from skald.operators import lexicon as L, planning as P, script as S
from skald.plans.registry import query, workspace
from skald.plans.views import duck, table, view
from skald.sources import files

TAG = r"\[/?[A-Za-z_]+(?::[^\]]*)?\]"
T = "with " + duck("v_tagged")
B = T + ", r as (select script_id, script_text t from v_tagged)"


def tagged(spark, d) -> DataFrame:
    return view(spark, d, "v_tagged")


def numeric(spark, d) -> DataFrame:
    return view(spark, d, "v_numeric")


USER_LEXICON = {"_comment": "x", "Nevada": "neh-VAH-dah", "Harris": "HAIR-iss", "paid in": "PAYD in", "in Nevada": "never read"}
LEXICON_SQL = D.values_sql([*({**D.PRONUNCIATIONS, **{k: v for k, v in USER_LEXICON.items() if k[0] != "_"}}).items()], "word, spoken")


def user_lexicon(spark) -> DataFrame:
    """A user's lexicon file, written and read again, over the built-in lexicon."""
    path = workspace(spark, "lexicon")
    spark.range(1).select(F.lit(json.dumps(USER_LEXICON)).alias("value")).coalesce(1).write.text(path)
    return files.scan_pronunciations(spark, path)


@query("s4_scan_pronunciations", "with " + duck("v_numeric") + ", w as (select distinct script_id, unnest(regexp_extract_all(script_text, '[A-Za-z]+')) word from v_numeric), l as (select * from " + LEXICON_SQL + ") select script_id, word, spoken from w join l using (word)")
def s4(spark, d):
    """The words of every script that a user's lexicon file or the built-in lexicon respells."""
    words = numeric(spark, d).select("script_id", F.explode(F.array_distinct(F.regexp_extract_all("script_text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("word"))
    return words.join(user_lexicon(spark), "word").select("script_id", "word", "spoken")


@query("p1_strip_markup", T + rf" select script_id, regexp_replace(script_text, '{TAG}', '', 'g') plain from v_tagged")
def p1(spark, d):
    return tagged(spark, d).select("script_id", X.strip_markup(F.col("script_text")).alias("plain"))


@query("p2_clean_for_tts", T + rf" select script_id, trim(regexp_replace(regexp_replace(script_text, '{TAG}', '', 'g'), '\s+', ' ', 'g')) plain from v_tagged")
def p2(spark, d):
    return tagged(spark, d).select("script_id", X.clean(F.col("script_text")).alias("plain"))


SIMPLE = r"string_split(regexp_replace({0}, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1))"
SENTS = "s0 as (select script_id, unnest(" + SIMPLE.format("script_text") + ") sentence, unnest(range(0, len(" + SIMPLE.format("script_text") + "))) sent_no from {0}), s as (select * from s0 where trim(sentence) <> '')"


@query("t4b_split_sentences_simple", "with " + duck("v_script") + ", " + SENTS.format("v_script") + " select script_id, cast(sent_no as int) sent_no, sentence from s")
def t4b(spark, d):
    return S.simple_sentences(view(spark, d, "v_script")).select("script_id", "sent_no", "sentence")


@query("p3_speakable", "with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents) select doc_id, count(*) filter (trim(line) <> '') spoken from l group by 1")
def p3(spark, d):
    full = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").groupBy("doc_id").agg(F.sum(F.coalesce(F.size(full), F.lit(0))).cast("long").alias("spoken"))


DIALOGUE = r"\b([A-Z][a-z]+)\s+(?:said|asked|replied|whispered|shouted|murmured|sobbed|laughed|growled|breathed)\b"
TALK = "(regexp_matches(sentence, '" + DIALOGUE + "') or regexp_matches(sentence, '" + S.BENGALI_SAID + "') or regexp_matches(sentence, '[\"“”‘’''].+?[\"“”‘’'']'))"
TALK = TALK.replace("‘’''", "‘’")


@query("e1_detect_dialogue", T + ", " + SENTS.format("v_tagged") + f" select script_id, cast(sent_no as int) sent_no, {TALK} is_dialogue, regexp_extract(sentence, '{DIALOGUE}', 1) speaker from s")
def e1(spark, d):
    s = F.col("sentence")
    return S.simple_sentences(tagged(spark, d)).select("script_id", "sent_no", S.is_dialogue(s).alias("is_dialogue"), S.speaker(s).alias("speaker"))


@query("p5_detect_dialogues", T + ", " + SENTS.format("v_tagged") + f" select script_id, cast(sent_no as int) sent_no, sentence from s where {TALK}")
def p5(spark, d):
    return S.simple_sentences(tagged(spark, d)).where(S.is_dialogue(F.col("sentence"))).select("script_id", "sent_no", "sentence")


LEX = [(i, c, e) for i, (c, e) in enumerate((c, e) for g, e in D.CUES for c in g)]
CUE = ", lex as (select * from " + D.values_sql(LEX, "priority, cue, emotion") + "), cue as (select script_id, sent_no, min_by(emotion, priority) cue_emotion from s, lex where contains(lower(sentence), cue) group by 1, 2)"


@query("e2_cue_emotion", T + ", " + SENTS.format("v_tagged") + CUE + " select script_id, cast(sent_no as int) sent_no, cue_emotion from s left join cue using (script_id, sent_no)")
def e2(spark, d):
    return L.first_cue(S.simple_sentences(tagged(spark, d)), D.cues(spark)).select("script_id", "sent_no", "cue_emotion")


MARK = "case when rtrim(sentence) like '%!' and regexp_matches(lower(sentence), 'no|stop|run|help') then 'FEAR' when rtrim(sentence) like '%!' then 'EXCITED' when rtrim(sentence) like '%?' and regexp_matches(lower(sentence), '\\b(who|what|where|why|how)\\b') then 'MYSTERIOUS' end"


@query("e3_punctuation_emotion", "with " + duck("v_script") + ", " + SENTS.format("v_script") + f", m as (select *, {MARK} emotion from s) select script_id, cast(sent_no as int) sent_no, emotion, case emotion when 'FEAR' then 0.6 when 'EXCITED' then 0.5 when 'MYSTERIOUS' then 0.4 end::double confidence from m")
def e3(spark, d):
    emotion, sure = S.punctuation_emotion(F.col("sentence"))
    return S.simple_sentences(view(spark, d, "v_script")).select("script_id", "sent_no", emotion.alias("emotion"), sure.cast("double").alias("confidence"))


ANALYSED = T + ", " + SENTS.format("v_tagged") + CUE + f", m as (select s.*, cue_emotion, {MARK} mark, regexp_matches(lower(sentence), '\\bwhisper(ed|s)?\\b') hush from s left join cue using (script_id, sent_no)), a as (select script_id, sent_no, sentence, case when hush then 'WHISPER' else coalesce(cue_emotion, mark, 'NEUTRAL') end emotion, case when hush then 0.8 when cue_emotion is not null then 0.75 when mark = 'FEAR' then 0.6 when mark = 'EXCITED' then 0.5 when mark = 'MYSTERIOUS' then 0.4 else 0 end::double intensity, {TALK} is_dialogue from m)"


@query("e4_analyze_sentence", ANALYSED + " select script_id, cast(sent_no as int) sent_no, emotion, intensity, is_dialogue from a")
def e4(spark, d):
    return S.analyse(S.simple_sentences(tagged(spark, d))).select("script_id", "sent_no", "emotion", F.col("intensity").cast("double"), "is_dialogue")


@query("t7_annotate_script", ANALYSED + " select script_id, cast(sent_no as int) sent_no, coalesce(last_value(case when emotion not in ('NEUTRAL', 'WHISPER') and intensity >= 0.55 - 0.15 * 0.7 then emotion end ignore nulls) over (partition by script_id order by sent_no rows between unbounded preceding and current row), '') tag_emotion, emotion = 'WHISPER' whispered from a")
def t7(spark, d):
    return S.annotate(S.analyse(S.simple_sentences(tagged(spark, d)))).select("script_id", "sent_no", "tag_emotion", "whispered")


def hit(label: str) -> str:
    return "(" + " or ".join(f"contains(lower(sentence), '{c.replace(chr(39), chr(39) * 2)}')" for c in D.STRUCTURE[label]) + ")"


@query("e5_detect_story_structure", T + ", " + SENTS.format("v_tagged") + f""", x as (select script_id, row_number() over (partition by script_id order by sent_no) - 1 i, count(*) over (partition by script_id) n, sentence from s),
c as (select *, coalesce(min(i) filter ({hit('Conflict')} and i >= n // 10) over (partition by script_id), -1) c from x),
u as (select *, coalesce(min(i) filter ({hit('Suspense')} and i >= greatest(c, n // 3)) over (partition by script_id), -1) u from c),
k as (select *, coalesce(min(i) filter ({hit('Climax')} and i >= greatest(u, floor(n * 0.7))) over (partition by script_id), -1) k from u),
r as (select *, coalesce(min(i) filter ({hit('Resolution')} and i >= greatest(k, floor(n * 0.85))) over (partition by script_id), -1) r from k),
o as (select script_id, max(n) n, max(c) c, max(u) u, max(k) k, max(r) r from r group by 1),
p as (select script_id, n, 'Introduction' as label, 0 start_sentence from o union all select script_id, n, 'Conflict', c from o where c > 0 union all select script_id, n, 'Suspense', u from o where u > greatest(c, 0)
 union all select script_id, n, 'Climax', k from o where k > greatest(u, 0) union all select script_id, n, 'Resolution', r from o where r > greatest(k, 0))
select script_id, label, cast(start_sentence as bigint) start_sentence, cast(coalesce(lead(start_sentence) over (partition by script_id order by start_sentence) - 1, n - 1) as bigint) end_sentence from p""")
def e5(spark, d):
    from pyspark.sql import Window

    rows = S.simple_sentences(tagged(spark, d)).withColumn("sent_no", F.row_number().over(Window.partitionBy("script_id").orderBy("sent_no")) - 1)
    return S.structure(rows)


GROUPED = ", g as (select script_id, sent_no // 4 chunk, avg(cast(is_dialogue as int)) share from a group by 1, 2)"


def dialogue_share(spark, d) -> DataFrame:
    rows = S.analyse(S.simple_sentences(tagged(spark, d))).withColumn("chunk", F.floor(F.col("sent_no") / 4))
    share = F.avg(F.col("is_dialogue").cast("int"))
    return rows.groupBy("script_id", "chunk").agg(((share >= 0.4) & (share > 0)).alias("is_dialogue"))


@query("e6_is_dialogue_chunk", ANALYSED + GROUPED + " select script_id, cast(chunk as bigint) chunk, share >= 0.4 and share > 0 is_dialogue from g")
def e6(spark, d):
    return dialogue_share(spark, d)


@query("e7_route_voice", ANALYSED + GROUPED + " select script_id, cast(chunk as bigint) chunk, case when share >= 0.4 and share > 0 then 'en-US-GuyNeural' else 'en-US-AriaNeural' end voice_id from g")
def e7(spark, d):
    return dialogue_share(spark, d).select("script_id", "chunk", F.when(F.col("is_dialogue"), D.DIALOGUE["edge"]).otherwise(D.NARRATOR["edge"]).alias("voice_id"))


# markup in SQL: the same steps over unnested parts
PARTS = B + rf""", p as (select script_id, unnest(range(0, len(string_split_regex(t, '{TAG}')))) i, unnest(string_split_regex(t, '{TAG}')) part,
 unnest(list_concat([''], regexp_extract_all(t, '{TAG}'))) tag from r),
h as (select *, upper(regexp_extract(tag, '^\[(/?[A-Za-z_]+)', 1)) head, trim(regexp_extract(tag, ':([^\]]*)\]$', 1)) val from p),
f as (select *, case when head = 'EMOTION' then upper(val) end emo, case when head = 'PAUSE' then greatest(0, least(10, coalesce(try_cast(case when val = '' then '1' else val end as double), 1))) else 0 end pause,
 cast(head in ('PAUSE', 'EMOTION', 'WHISPER', 'EMPHASIS', 'BREATH', 'LAUGH', 'CRY', 'LOW', 'HIGH', '/WHISPER', '/EMPHASIS', '/BREATH', '/LAUGH', '/CRY', '/LOW', '/HIGH') as int) known,
 case head when 'WHISPER' then true when '/WHISPER' then false end w, case head when 'EMPHASIS' then true when '/EMPHASIS' then false end e from h),
st as (select *, sum(known) over o grp, last_value(emo ignore nulls) over o cur, last_value(w ignore nulls) over o cw, last_value(e ignore nulls) over o ce from f window o as (partition by script_id order by i rows between unbounded preceding and current row)),
gr as (select script_id, grp, string_agg(part, '' order by i) txt, max_by(cur, i) emotion, sum(pause) pause, max_by(cw, i) cw, max_by(ce, i) ce from st group by 1, 2),
fl as (select *, cast(trim(regexp_replace(txt, '\s+', ' ', 'g')) <> '' as int) is_full from gr),
nu as (select *, sum(is_full) over (partition by script_id order by grp) seg_no from fl),
pa as (select script_id, seg_no - is_full seg_no, sum(pause) pause_after from nu group by 1, 2),
seg as (select n.script_id, n.seg_no, regexp_replace(txt, '\s+$', '') txt, coalesce(emotion, '') emotion, case when ce and cw then 'emphasis,whisper' when ce then 'emphasis' when cw then 'whisper' else '' end effects, coalesce(pause_after, 0) pause_after
 from nu n left join pa on pa.script_id = n.script_id and pa.seg_no = n.seg_no where is_full = 1)"""


@query("t1_parse_markup", PARTS + " select script_id, cast(seg_no as bigint) seg_no, txt as segment_text, emotion, effects, cast(pause_after as double) pause_after from seg")
def t1(spark, d):
    s = S.segments(tagged(spark, d))
    return s.select("script_id", F.col("seg_no").cast("long"), F.col("text").alias("segment_text"), "emotion", F.array_join("effects", ",").alias("effects"), F.col("pause_after").cast("double"))


@query("a14_plain_text", PARTS + " select script_id, string_agg(txt, chr(10) order by seg_no) plain from seg group by 1")
def a14(spark, d):
    rows = S.segments(tagged(spark, d)).groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", "text"))).alias("s"))
    return rows.select("script_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("plain"))


@query("a13_chunk_effects", PARTS + ", ef as (select script_id, unnest(string_split(effects, ',')) e from seg) select script_id, coalesce((select string_agg(distinct e, ',' order by e) from ef where ef.script_id = s.script_id and e <> ''), '') effects, coalesce(max_by(emotion, seg_no) filter (emotion <> ''), '') emotion from seg s group by script_id")
def a13(spark, d):
    g = S.segments(tagged(spark, d)).groupBy("script_id")
    effects = F.array_sort(F.array_distinct(F.flatten(F.collect_list("effects"))))
    return g.agg(F.array_join(effects, ",").alias("effects"), F.coalesce(F.max_by("emotion", F.when(F.col("emotion") != "", F.col("seg_no"))), F.lit("")).alias("emotion"))


@query("t2_unknown_tags", B + rf", u as (select script_id, unnest(regexp_extract_all(t, '{TAG}')) tag from r) select script_id, tag from u where upper(regexp_extract(tag, '^\[(/?[A-Za-z_]+)', 1)) not in ('SCENE', 'PAUSE', 'EMOTION', 'WHISPER', 'EMPHASIS', '/WHISPER', '/EMPHASIS')")
def t2(spark, d):
    return S.unknown_tags(tagged(spark, d))


SC = r"(?i)^\s*(?:\[\s*SCENE\s*:?\s*([^\]]*)\]\s*|#{1,3}\s*(.+))$"
SCENES = B + rf""", bl as (select script_id, unnest(range(0, len(string_split(t, chr(10) || chr(10))))) para_no, unnest(string_split(t, chr(10) || chr(10))) block from r),
ln as (select *, list_filter(string_split(block, chr(10)), lambda x: regexp_matches(trim(x), '{SC}')) marks from bl),
bo as (select script_id, para_no, len(marks) > 0 m, trim(regexp_extract(trim(marks[1]), '{SC}', 1) || regexp_extract(trim(marks[1]), '{SC}', 2)) ti,
 case when len(marks) > 0 then array_to_string(list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '' and not regexp_matches(trim(x), '{SC}')), chr(10)) else block end paragraph from ln),
cu as (select *, sum(cast(m as int)) over o sc, last_value(case when m then ti end ignore nulls) over o tt from bo window o as (partition by script_id order by para_no rows between unbounded preceding and current row)),
sn as (select script_id, dense_rank() over (partition by script_id order by sc) scene_id, tt, para_no, paragraph from cu where trim(regexp_replace(paragraph, '\s+', ' ', 'g')) <> '')"""


@query("t3_split_scenes", SCENES + " select script_id, cast(scene_id as int) scene_id, coalesce(nullif(tt, ''), 'Scene ' || scene_id) title, cast(para_no as int) para_no, paragraph from sn")
def t3(spark, d):
    return S.scenes(tagged(spark, d))


ABBR = ", ".join(f"'{a}'" for a in D.ABBREVIATIONS)
SENT4A = rf""", ll as (select script_id, unnest(range(0, len(string_split({{1}}, chr(10))))) li, unnest(string_split({{1}}, chr(10))) line from {{0}}),
pp as (select script_id, li, string_split(regexp_replace(regexp_replace(line, '([.!?।])\s+(["''A-Z0-9\x{{{{0980}}}}-\x{{{{09FF}}}}])', '\1' || chr(1) || '\2', 'g'), '([.!?।]["”’])\s+', '\1' || chr(1), 'g'), chr(1)) parts from ll),
pi as (select script_id, li, unnest(range(0, len(parts))) pj, trim(unnest(parts)) p from pp),
pl as (select *, regexp_replace(lower(regexp_replace(regexp_extract(p, '(\S+)$', 1), '[").]+$', '')), '\.+$', '') in ({ABBR}) and not regexp_matches(p, '[!?]$') short from pi where p <> ''),
gl as (select *, coalesce(lag(short) over (partition by script_id, li order by pj), false) goes from pl),
gn as (select *, sum(cast(not goes as int)) over (partition by script_id order by li, pj) n from gl),
se as (select script_id, n, string_agg(p, ' ' order by li, pj) sentence from gn group by 1, 2),
s4 as (select script_id, row_number() over (partition by script_id order by n) - 1 sent_no, sentence from se)"""


def sent4a(source: str, text: str) -> str:
    return SENT4A.format(source, text).replace("{{", "{").replace("}}", "}")


@query("t4a_split_sentences", "with " + duck("v_script") + sent4a("v_script", "script_text") + " select script_id, cast(sent_no as int) sent_no, sentence from s4")
def t4a(spark, d):
    return S.sentences(view(spark, d, "v_script")).select("script_id", F.col("sent_no").cast("int"), "sentence")


CLAUSES = r"list_transform(string_split(regexp_replace(sentence, '([,;:।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: [c])"
PACKED = f"list_reduce({CLAUSES}, lambda acc, x: case when length(acc[-1]) + length(x[1]) + 1 <= 200 then list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) else list_concat(acc, x) end)"


@query("t5_hard_split", "with " + duck("v_script") + ", " + SENTS.format("v_script") + f", h as (select script_id, sent_no, case when length(sentence) <= 200 then [sentence] else {PACKED} end parts from s) select script_id, cast(sent_no as int) sent_no, cast(unnest(range(0, len(parts))) as int) part, unnest(parts) as text from h")
def t5(spark, d):
    s = S.simple_sentences(view(spark, d, "v_script"))
    return s.select("script_id", "sent_no", F.posexplode(S.hard_split(F.col("sentence"), 200)).alias("part", "text"))


def plain_chunks(spark, d) -> DataFrame:
    """Chunks of the untagged scripts: no scenes, no effects, no pauses."""
    scripts = view(spark, d, "v_script")
    rows = S.sentences(scripts).join(scripts.select("script_id", "target_wpm", "words_per_chunk"), "script_id")
    return S.chunk_groups(rows.withColumns({"scene_id": F.floor(F.col("sent_no") / 15) + 1, "effects": F.array().cast("array<string>"), "emotion": F.lit(""), "pause": F.lit(0.0)}))


CHUNKED = "with " + duck("v_script") + sent4a("v_script", "script_text") + """, fb as (select *, sent_no // 15 + 1 scene_id from s4),
ff as (select *, coalesce(lag(scene_id) over (partition by script_id order by sent_no) <> scene_id, true) or len(string_split(sentence, ' ')) >= 45 brk from fb),
fr as (select *, sum(cast(brk as int)) over (partition by script_id order by sent_no) run from ff),
fp as (select *, (row_number() over (partition by script_id, run order by sent_no) - 1) // 4 part from fr),
fc as (select *, dense_rank() over (partition by script_id order by run, part) - 1 chunk_id from fp),
ck as (select script_id, chunk_id, min(scene_id) scene_id, string_agg(sentence, ' ' order by sent_no) txt from fc group by 1, 2),
cw as (select c.*, len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda x: x <> '')) words, target_wpm, case when regexp_matches(rtrim(txt), '[.!?।]$') then round(0.35 * (0.85 + 0.30 * (cast(('0x' || substr(sha1('pause:' || txt), 1, 8)) as bigint)::double / 4294967295.0)), 3) else 0 end::double pause_after from ck c join v_script using (script_id))"""


@query("t6_build_chunks", CHUNKED + " select script_id, cast(chunk_id as int) chunk_id, cast(scene_id as bigint) scene_id, txt as chunk_text from ck")
def t6(spark, d):
    c = S.chunks(plain_chunks(spark, d))
    return c.select("script_id", F.col("chunk_id").cast("int"), F.col("scene_id").cast("long"), F.col("text").alias("chunk_text"))


@query("w1_number_chunks", CHUNKED + " select script_id, cast(chunk_id as int) chunk_id, cast(row_number() over (partition by script_id, scene_id order by chunk_id) - 1 as int) index_in_scene from ck")
def w1(spark, d):
    return S.chunks(plain_chunks(spark, d)).select("script_id", F.col("chunk_id").cast("int"), F.col("index_in_scene").cast("int"))


@query("w4_chunk_pauses", CHUNKED + " select script_id, cast(chunk_id as int) chunk_id, pause_after, round(words / greatest(60, target_wpm)::double * 60.0 + pause_after, 3) est_seconds from cw")
def w4(spark, d):
    return S.chunks(plain_chunks(spark, d)).select("script_id", F.col("chunk_id").cast("int"), F.col("pause_after").cast("double"), "est_seconds")


@query("a2_estimated_total", CHUNKED + " select script_id, count(*) n_chunks, cast(sum(cast(round(words / greatest(60, target_wpm)::double * 60.0 + pause_after, 3) as decimal(18, 3))) as double) total from cw group by 1")
def a2(spark, d):
    return S.chunks(plain_chunks(spark, d)).groupBy("script_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("est_seconds").cast("decimal(18,3)")).cast("double").alias("total"))


@query("a1_script_stats", "with w as (select doc_id, length(text) chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) words from documents) select doc_id, cast(words as bigint) words, cast(chars as bigint) chars, printf('%d:%02d', cast(words * 60 // 155 // 60 as bigint), cast(words * 60 // 155 % 60 as bigint)) estimate from w")
def a1(spark, d):
    w = X.word_count(F.col("text"))
    s = F.floor(w * 60 / 155)
    return table(spark, d, "documents").select("doc_id", w.cast("long").alias("words"), F.length("text").cast("long").alias("chars"), F.format_string("%d:%02d", F.floor(s / 60), s % 60).alias("estimate"))


@query("t8_process_scripts")
def t8(spark, d):
    scripts = tagged(spark, d).withColumns({"target_wpm": F.lit(150), "words_per_chunk": F.lit(45)})
    c = S.process(scripts)
    return c.select("script_id", "chunk_id", "scene_id", "text", "words", "emotion", F.array_join("effects", ",").alias("effects"), "pause_before", "pause_after", "est_seconds")


# numbers in words: a table of 0..999 in SQL, composed by joins
ONES_SQL = "['" + "','".join(X.ONES) + "']"
TENS_SQL = "['" + "','".join(X.TENS) + "']"
ORD_SQL = "['" + "','".join([*X.ORDINALS, *(f"twenty-{o}" for o in X.ORDINALS[1:10]), "thirtieth", "thirty-first"]) + "']"
U100 = "case when {n} < 20 then {o}[{n} + 1] when {n} % 10 = 0 then {t}[{n} // 10 + 1] else {t}[{n} // 10 + 1] || '-' || {o}[{n} % 10 + 1] end"
W999 = ", w as (select n, case when n = 0 then 'zero' else concat_ws(' ', case when n >= 100 then " + ONES_SQL + "[n // 100 + 1] || ' hundred' end, case when n % 100 > 0 then " + U100.format(n="(n % 100)", o=ONES_SQL, t=TENS_SQL) + " end) end s from range(0, 1000) t(n))"


def words_sql(n: str) -> str:
    """Words of a number below a million, from the table."""
    return f"(case when {n} < 1000 then (select s from w where w.n = {n}) else (select s from w where w.n = {n} // 1000) || ' thousand' || case when {n} % 1000 > 0 then ' ' || (select s from w where w.n = {n} % 1000) else '' end end)"


def year_sql(y: str) -> str:
    pair = f"{words_sql(f'({y} // 100)')} || ' ' || case when {y} % 100 = 0 then 'hundred' else replace({words_sql(f'({y} % 100)')}, '-', ' ') end"
    return f"case when {y} between 1000 and 1999 or {y} between 2010 and 2099 then {pair} else {words_sql(y)} end"


PARTS = f"""{words_sql('pct')} || ' percent' pct_w,
 {words_sql('hh')} || ' ' || case when mi = 0 then 'o''clock' when mi < 10 then 'zero ' || {ONES_SQL}[mi + 1] else {words_sql('mi')} end time_w, {words_sql('km')} || ' kilometers' km_w,
 {year_sql('y')} year_w,
 ['{"','".join(X.MONTHS)}'][mo] || ' ' || {ORD_SQL}[dd + 1] date_w"""
N = "with " + duck("v_numeric") + W999 + f""", o as (select o_orderkey k, cast(floor(o_totalprice) as bigint) price, o_orderkey % 100 cents, o_orderkey % 40 pct, o_orderkey % 12 + 1 hh, o_orderkey % 60 mi, o_orderkey % 90 km,
 year(o_orderdate) y, month(o_orderdate) mo, day(o_orderdate) dd from orders),
x as (select k, {words_sql('k')} key_w, {words_sql('price')} || ' dollars and ' || {ONES_SQL}[cents // 10 + 1] || ' ' || {ONES_SQL}[cents % 10 + 1] || ' cents' money_w, {PARTS} from o),
spoken as (select k, case when k between 1800 and 2099 then {year_sql('k')} else {words_sql('k')} end order_w from o)"""


S999 = f"concat_ws(' ', case when {{n}} >= 100 then {ONES_SQL}[{{n}} // 100 + 1] || ' hundred' end, case when {{n}} % 100 > 0 then {U100.format(n='({n} % 100)', o=ONES_SQL, t=TENS_SQL)} end)"


def long_words_sql(n: str) -> str:
    """Words of any whole number that isn't negative: groups of three digits, with a billion after every third."""
    scale = "case when p in (1000, 1000000000000) then ' thousand' when p in (1000000, 1000000000000000) then ' million' else '' end"
    group = f"case when {n} // p % 1000 > 0 then ' ' || {S999.format(n=f'({n} // p % 1000)')} || {scale} else '' end"
    billion = f"case when p in (1000000000, 1000000000000000000) and {n} >= p then ' billion' else '' end"
    return f"case when {n} = 0 then 'zero' else ltrim(array_to_string(list_transform([{', '.join(str(1000**i) for i in range(6, -1, -1))}], lambda p: {group} || {billion}), '')) end"


# keys and prices of any size; a whole number of over nine digits in a text is said digit by digit
LONG = N + f""", y as (select k, {long_words_sql('k')} key_w, {long_words_sql('price')} || ' dollars and ' || {ONES_SQL}[cents // 10 + 1] || ' ' || {ONES_SQL}[cents % 10 + 1] || ' cents' money_w, {PARTS} from o),
heard as (select *, case when k between 1800 and 2099 then {year_sql('k')} when k > 999999999 then array_to_string(list_transform(regexp_extract_all(cast(k as varchar), '.'), lambda c: {ONES_SQL}[cast(c as int) + 1]), ' ') else key_w end order_w from y)"""


def padded(k):
    """A key's digits, filled up with zeros to nine, or to the next multiple of nine."""
    return F.lpad(k, F.ceil(F.length(k) / 9).cast("int") * 9, F.lit("0"))


@query("n1_number_to_words", LONG + " select k, key_w as said, case when k = 0 then key_w else 'minus ' || key_w end minus_said, key_w || ' billion ' || key_w || ' billion ' || key_w || ' billion' long_said from y where k > 0 union all select k, key_w, key_w, key_w from y where k = 0")
def n1(spark, d):
    """Keys, their negatives, and numbers of 28 digits and more made of the key."""
    k = F.col("o_orderkey")
    nine = padded(k.cast("string"))
    long = F.concat(k.cast("string"), nine, nine, F.lit("0" * 9))
    return table(spark, d, "orders").select(k.alias("k"), X.number_words(k).alias("said"), X.number_words(-k).alias("minus_said"), X.number_words(long).alias("long_said"))


@query("n2_year_to_words", N + " select k, year_w as said from x")
def n2(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), X.year_words(F.year("o_orderdate")).alias("said"))


@query("n3_normalize_number_token", N + f" select x.k, 'minus ' || {words_sql('price')} || ' point ' || {ONES_SQL}[cents // 10 + 1] || ' ' || {ONES_SQL}[cents % 10 + 1] said from x join o using (k)")
def n3(spark, d):
    k = F.col("o_orderkey")
    token = F.concat(F.lit("-"), F.format_number(F.floor("o_totalprice"), 0), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    return table(spark, d, "orders").select(k.alias("k"), X.number_token(token).alias("said"))


def one_pass(name: str):
    """A pass alone on the numeric scripts; what it says is looked for in the text."""

    def run(spark, d) -> DataFrame:
        return numeric(spark, d).select("script_id", X.PASSES[name](F.col("script_text")).alias("said"))

    return run


@query("n4_long_amounts", LONG + " select k, 'Paid ' || key_w || ' billion ' || key_w || ' euros and one two cents, up ' || key_w || ' billion ' || key_w || ' point five percent in ' || key_w || ' billion ' || key_w || ' point two five miles' said from y where k > 0")
def n4_long(spark, d):
    """Amounts, shares and measures of more than twelve digits."""
    k = F.col("o_orderkey").cast("string")
    long = F.concat(k, padded(k))
    text = F.concat(F.lit("Paid €"), long, F.lit(".129, up "), long, F.lit(".5% in "), long, F.lit(".25 miles"))
    return table(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("k"), X.normalise(text).alias("said"))


RAW_MONEY = "'$' || price || '.' || lpad(cast(cents as varchar), 2, '0')"
query("n4_normalize_money", N + f" select script_id, replace(script_text, {RAW_MONEY}, money_w) said from v_numeric join x on k = script_id join o using (k)")(one_pass("money"))
query("n5_normalize_percent", N + " select script_id, replace(script_text, ' ' || pct || '%', ' ' || pct_w) said from v_numeric join x on k = script_id join o using (k)")(one_pass("percent"))
query("n6_normalize_time", N + " select script_id, replace(script_text, ' ' || hh || ':' || lpad(cast(mi as varchar), 2, '0'), ' ' || time_w) said from v_numeric join x on k = script_id join o using (k)")(one_pass("time"))
query("n7_normalize_measure", N + " select script_id, replace(script_text, ' ' || km || ' km', ' ' || km_w) said from v_numeric join x on k = script_id join o using (k)")(one_pass("measure"))
query("n8_normalize_dates", N + r" select script_id, regexp_replace(script_text, ' of .* cost', ' of ' || date_w || ', ' || year_w || ' cost') said from v_numeric join x on k = script_id join o using (k)")(one_pass("dates"))
query("n10_strip_abbrev_dots", "with " + duck("v_numeric") + " select script_id, replace(script_text, 'Dr. ', 'Dr ') said from v_numeric")(one_pass("abbreviations"))
query("n11_normalize", LONG + " select k script_id, 'Order ' || order_w || ' of ' || date_w || ', ' || year_w || ' cost ' || money_w || ' less ' || pct_w || ' at ' || time_w || ' after ' || km_w || '. Dr Harris paid in Nevada.' said from heard")(lambda spark, d: numeric(spark, d).select("script_id", X.normalise(F.col("script_text")).alias("said")))

SPEAK = "url"
for _a, _b in X.URL_WORDS:
    SPEAK = f"replace({SPEAK}, '{_a}', '{_b}')"


@query("n9_normalize_urls", f"select page_id, 'see ' || {SPEAK} || ' now' said from pages")
def n9(spark, d):
    return table(spark, d, "pages").select("page_id", X.PASSES["urls"](F.concat(F.lit("see "), "url", F.lit(" now"))).alias("said"))


@query("l1_apply_pronunciations", "with " + duck("v_numeric") + r" select script_id, replace(replace(replace(script_text, 'Harris', 'HAIR-iss'), 'paid in', 'PAYD in'), 'Nevada', 'neh-VAH-dah') said, 3 as hits from v_numeric")
def l1(spark, d):
    """A user's lexicon file applied to every script; 'paid in' begins before 'in Nevada' and wins."""
    return L.respell(numeric(spark, d), user_lexicon(spark)).select("script_id", "said", "hits")
