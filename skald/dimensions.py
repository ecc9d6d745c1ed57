"""Dimension tables: presets, emotion profiles, voices, loudness targets, cue lexicon, pronunciations.

All are small literal tables of fixed size; joins with them may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Key, wpm, emotion_intensity, pause_scale, voice_style, music_mood, music_gain_db, ducking_db, loudness.
PRESETS = [
    ("DOCUMENTARY", 150, 0.5, 1.0, "documentary", "Documentary", -20.0, 9.0, "YouTube"),
    ("HORROR", 145, 0.85, 1.6, "horror", "Dark", -22.0, 11.0, "YouTube"),
    ("MYSTERY", 148, 0.7, 1.4, "mystery", "Mystery", -21.0, 10.0, "YouTube"),
    ("TRUE_CRIME", 150, 0.65, 1.3, "serious", "Mystery", -20.0, 10.0, "YouTube"),
    ("EMOTIONAL", 152, 0.75, 1.2, "warm", "Emotional", -20.0, 9.0, "YouTube"),
    ("MOTIVATIONAL", 162, 0.8, 0.9, "cinematic", "Inspirational", -19.0, 8.0, "YouTube"),
    ("ROMANCE", 150, 0.7, 1.25, "warm", "Calm", -20.0, 9.0, "YouTube"),
    ("SCI_FI", 155, 0.7, 1.15, "cinematic", "Dramatic", -20.0, 9.0, "YouTube"),
    ("HISTORICAL", 148, 0.55, 1.1, "documentary", "Documentary", -20.0, 9.0, "YouTube"),
    ("BEDTIME", 132, 0.45, 1.7, "calm", "Calm", -23.0, 12.0, "Podcast"),
    ("DARK_STORY", 143, 0.8, 1.5, "deep", "Dark", -22.0, 11.0, "YouTube"),
    ("CINEMATIC", 153, 0.85, 1.35, "cinematic", "Cinematic", -19.0, 9.0, "YouTube"),
]
PRESET_SCHEMA = "preset string, wpm int, preset_intensity double, preset_pause_scale double, voice_style string, music_mood string, music_gain_db double, ducking_db double, loudness string"
DEFAULT_PRESET = "DOCUMENTARY"

# Emotion, rate_scale, pause_scale, intensity, pitch_semitones.
PROFILES = [
    ("CALM", 1.08, 1.3, 0.4, 0.0),
    ("HAPPY", 0.94, 0.8, 0.7, 0.0),
    ("SAD", 1.12, 1.5, 0.8, 0.0),
    ("FEAR", 1.05, 1.6, 0.9, 0.0),
    ("HORROR", 1.14, 1.8, 0.85, 0.0),
    ("SUSPENSE", 1.10, 1.7, 0.8, 0.0),
    ("EXCITED", 0.90, 0.7, 0.85, 0.0),
    ("ANGRY", 0.95, 0.9, 0.9, 0.0),
    ("SURPRISE", 0.96, 1.0, 0.75, 0.0),
    ("ROMANTIC", 1.06, 1.35, 0.65, 0.0),
    ("MYSTERIOUS", 1.10, 1.55, 0.75, 0.0),
    ("SERIOUS", 1.04, 1.15, 0.5, 0.0),
    ("HOPEFUL", 1.00, 1.05, 0.6, 0.0),
    ("DRAMATIC", 1.02, 1.45, 0.9, 0.0),
    ("WHISPER", 1.16, 1.6, 0.7, -1.5),
    ("NEUTRAL", 1.00, 1.00, 0.0, 0.0),
]
PROFILE_SCHEMA = "emotion string, rate_scale double, pause_scale double, intensity double, pitch_semitones double"

# Style directions by emotion and by preset.
EMOTION_STYLE = [
    ("CALM", "in a calm, steady voice"),
    ("HAPPY", "cheerfully, with a bright smile in the voice"),
    ("SAD", "in a sad, heavy voice, slowly"),
    ("FEAR", "in a fearful, trembling voice"),
    ("HORROR", "in a dark, ominous whisper"),
    ("SUSPENSE", "in a tense, hushed voice, building suspense"),
    ("EXCITED", "with energetic excitement"),
    ("ANGRY", "in an angry, forceful voice"),
    ("SURPRISE", "with genuine surprise"),
    ("ROMANTIC", "in a warm, tender voice"),
    ("MYSTERIOUS", "in a mysterious, quiet voice"),
    ("SERIOUS", "in a serious, formal tone"),
    ("HOPEFUL", "in a hopeful, uplifting voice"),
    ("DRAMATIC", "with dramatic intensity"),
    ("WHISPER", "in a soft whisper"),
    ("NEUTRAL", "in a clear, natural storytelling voice"),
]
PRESET_DIRECTION = [
    ("DOCUMENTARY", "measured and authoritative"),
    ("HORROR", "slow and intimate, full of dread"),
    ("MYSTERY", "quiet and full of intrigue"),
    ("TRUE_CRIME", "serious and factual, with suspenseful beats"),
    ("EMOTIONAL", "warm and empathetic"),
    ("MOTIVATIONAL", "energetic, rising toward a strong close"),
    ("ROMANCE", "soft, warm and unhurried"),
    ("SCI_FI", "cool and precise, with cinematic weight"),
    ("HISTORICAL", "with classic documentary gravitas"),
    ("BEDTIME", "very calm, soft and slow, soothing"),
    ("DARK_STORY", "grim and heavy, without theatrical excess"),
    ("CINEMATIC", "dynamic, with dramatic pauses"),
]

# voice_id, gender, style, language, of two engines.
EDGE_VOICES = [
    ("en-US-AriaNeural", "female", "News/Novel", "en-US"),
    ("en-US-JennyNeural", "female", "General", "en-US"),
    ("en-US-EmmaMultilingualNeural", "female", "Conversation", "en-US"),
    ("en-US-MichelleNeural", "female", "News", "en-US"),
    ("en-US-GuyNeural", "male", "News/Novel", "en-US"),
    ("en-US-AndrewMultilingualNeural", "male", "Conversation", "en-US"),
    ("bn-BD-NabanitaNeural", "female", "General", "bn-BD"),
    ("bn-BD-PradeepNeural", "male", "General", "bn-BD"),
]
GEMINI_VOICES = [
    ("Zephyr", "female", "Bright"),
    ("Kore", "female", "Firm"),
    ("Leda", "female", "Youthful"),
    ("Aoede", "female", "Breezy"),
    ("Callirrhoe", "female", "Easy-going"),
    ("Autonoe", "female", "Bright"),
    ("Erinome", "female", "Clear"),
    ("Despina", "female", "Smooth"),
    ("Laomedeia", "female", "Upbeat"),
    ("Achernar", "female", "Soft"),
    ("Vindemiatrix", "female", "Gentle"),
    ("Sulafat", "female", "Warm"),
    ("Gacrux", "female", "Versatile"),
    ("Pulcherrima", "female", "Versatile"),
    ("Puck", "male", "Upbeat"),
    ("Charon", "male", "Informative"),
    ("Fenrir", "male", "Excitable"),
    ("Orus", "male", "Firm"),
    ("Enceladus", "male", "Breathy"),
    ("Iapetus", "male", "Clear"),
    ("Umbriel", "male", "Easy-going"),
    ("Algieba", "male", "Smooth"),
    ("Algenib", "male", "Gravelly"),
    ("Rasalgethi", "male", "Informative"),
    ("Alnilam", "male", "Firm"),
    ("Schedar", "male", "Even"),
    ("Achird", "male", "Friendly"),
    ("Zubenelgenubi", "male", "Casual"),
    ("Sadachbia", "male", "Lively"),
    ("Sadaltager", "male", "Knowledgeable"),
]
VOICE_SCHEMA = "pos int, voice_id string, gender string, style string, language string, engine string"
VOICES = [(i, *v, "edge") for i, v in enumerate(EDGE_VOICES)] + [(len(EDGE_VOICES) + i, *v, "auto", "gemini") for i, v in enumerate(GEMINI_VOICES)]
NARRATOR = {"edge": "en-US-AriaNeural", "gemini": "Charon"}
DIALOGUE = {"edge": "en-US-GuyNeural", "gemini": "Puck"}

# Key, target level, ceiling.
LOUDNESS = [("YouTube", -14.0, -1.0), ("Podcast", -16.0, -1.5), ("Audiobook", -18.0, -3.0), ("Cinematic", -16.0, -1.5)]
LOUDNESS_SCHEMA = "loudness string, target_level double, ceiling double"

# Cues and the emotion they give, in the order in which they are looked for.
CUES = [
    (("whispered", "whispers", "whispering"), "WHISPER"),
    (("screamed", "shrieked", "yelled"), "EXCITED"),
    (("sobbed", "crying", "wept", "tears", "cried"), "SAD"),
    (("laughed", "chuckled", "smiled", "giggled"), "HAPPY"),
    (("terrified", "dread", "horrified"), "FEAR"),
    (("blood", "corpse", "dead body", "slashed"), "HORROR"),
    (("secret", "shadow", "figure in the dark", "footsteps approached"), "SUSPENSE"),
    (("suddenly", "without warning", "out of nowhere"), "SURPRISE"),
    (("angry", "furious", "rage", "snarled"), "ANGRY"),
    (("kissed", "love", "embraced"), "ROMANTIC"),
    (("mystery", "vanished", "strange", "eerie"), "MYSTERIOUS"),
    (("hope", "believed", "dreamed"), "HOPEFUL"),
    (("ফিসফিস",), "WHISPER"),
    (("চিৎকার", "চেঁচিয়ে", "চেঁচাল", "আর্তনাদ"), "EXCITED"),
    (("কাঁদ", "কেঁদে", "চোখের পানি", "অশ্রু"), "SAD"),
    (("হাস", "হেসে", "মুচকি"), "HAPPY"),
    (("ভয়", "আতঙ্ক", "শিউরে", "কেঁপে"), "FEAR"),
    (("রক্ত", "লাশ", "মৃতদেহ", "খুন"), "HORROR"),
    (("গোপন", "রহস্য", "ছায়া", "পায়ের শব্দ"), "SUSPENSE"),
    (("হঠাৎ", "আচমকা"), "SURPRISE"),
    (("রাগ", "রেগে", "ক্রোধ", "গর্জন"), "ANGRY"),
    (("ভালোবাস", "প্রেম", "আলিঙ্গন"), "ROMANTIC"),
    (("অদ্ভুত", "অদৃশ্য", "রহস্যময়"), "MYSTERIOUS"),
    (("আশা", "স্বপ্ন", "বিশ্বাস"), "HOPEFUL"),
]

# Cues of the parts of a story.
STRUCTURE = {
    "Conflict": ("but everything changed", "until one day", "then it happened", "problem was"),
    "Suspense": ("little did", "what he didn't know", "nobody knew", "the sound grew closer", "silence"),
    "Climax": ("finally", "at last", "it was over", "the moment came"),
    "Resolution": ("from that day", "ever since", "years later", "in the end"),
}

# Built-in respellings.
PRONUNCIATIONS = {
    "Worcestershire": "WOOS-ter-sheer",
    "Gloucester": "GLOS-ter",
    "Leicester": "LES-ter",
    "Arkansas": "AR-kan-saw",
    "Illinois": "il-i-NOY",
    "Nevada": "nuh-VAD-uh",
    "Oregon": "OR-uh-gun",
    "Detroit": "dih-TROIT",
    "Chicago": "shih-KAW-go",
    "Louisville": "LOO-uh-vul",
}

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "inc", "ltd", "co", "ave", "blvd", "no", "vol", "approx", "dept")

EFFECTS = ("whisper", "emphasis", "breath", "laugh", "cry", "low", "high")
LEGACY_ENGINES = {"piper": "edge", "parler": "edge"}
CHARACTERS = ("standard", "meditation", "psychology")
AUDIO_TYPES = (".wav", ".mp3", ".flac", ".ogg", ".m4a")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICES, VOICE_SCHEMA)


def loudness(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOUDNESS, LOUDNESS_SCHEMA)


def cues(spark: SparkSession) -> DataFrame:
    rows = [(i, cue, emotion) for i, (cue, emotion) in enumerate((c, e) for group, e in CUES for c in group)]
    return spark.createDataFrame(rows, "priority int, cue string, emotion string")


def values_sql(rows: list[tuple], names: str) -> str:
    """A literal table for SQL: ``(values ...) t(names)``."""

    def lit(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)

    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"
