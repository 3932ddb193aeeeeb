"""Words, patterns, lists and constants that results depend on.

Everything here has to keep exactly these values for results to stay comparable.
Regular expressions are Java syntax; ``(?iU)`` is case-insensitive and Unicode-aware.
"""

# --- label orders -----------------------------------------------------------------
MOODS = ["happy", "sad", "aggressive", "party", "relaxed", "acoustic", "electronic"]
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAP_FEATURES = [
    "bpm", "beat_confidence", "danceability", "onset_rate", "key_strength", "chord_strength_mean",
    "chord_change_rate", "integrated_lufs", "loudness_range_lu", "dynamic_complexity", "loudness_db",
    "spectral_centroid_mean", "spectral_rolloff_mean", "spectral_flux_mean", "zero_crossing_rate",
    "dissonance", "happy", "sad", "aggressive", "party", "relaxed", "acoustic", "electronic",
    "arousal", "valence", "mainstream_score", "active_score", "vocal_score",
]
CORRELATION_FEATURES = [
    "bpm", "beat_confidence", "danceability", "onset_rate", "key_strength", "chord_strength",
    "chord_change_rate", "lufs", "loudness_range", "dynamic_complexity", "loudness_db",
    "spectral_centroid", "spectral_rolloff", "spectral_flux", "zero_crossing_rate", "dissonance",
    "niche_score", "mainstream", "background", "active", "instrumental", "vocal", "female", "male",
    "arousal", "valence", "happy", "sad", "aggressive", "party", "relaxed", "acoustic", "electronic",
    "playcount", "listeners",
]
SERIES_COLUMNS = {
    "loudness": ("dsp", "loudness_short_term_timeseries"),
    "spectral_centroid": ("dsp", "spectral_centroid_timeseries"),
    "spectral_rolloff": ("dsp", "spectral_rolloff_timeseries"),
    "spectral_flux": ("dsp", "spectral_flux_timeseries"),
    "zero_crossing_rate": ("dsp", "zero_crossing_rate_timeseries"),
    "dissonance": ("dsp", "dissonance_timeseries"),
    "arousal": ("profile", "arousal_timeseries"),
    "valence": ("profile", "valence_timeseries"),
    "approachability": ("profile", "approachability_timeseries"),
    "engagement": ("profile", "engagement_timeseries"),
    "voice": ("profile", "voice_timeseries"),
    "gender": ("profile", "gender_timeseries"),
    "happy": ("moods", "happy_timeseries"),
    "sad": ("moods", "sad_timeseries"),
    "aggressive": ("moods", "aggressive_timeseries"),
    "party": ("moods", "party_timeseries"),
    "relaxed": ("moods", "relaxed_timeseries"),
    "acoustic": ("moods", "acoustic_timeseries"),
    "electronic": ("moods", "electronic_timeseries"),
}
INSTRUMENT_FAMILIES = {
    "percussion": ["drum", "percussion", "cymbal", "hi-hat", "snare", "kick", "tom", "clap"],
    "bass": ["bass"],
    "guitar": ["guitar", "banjo", "ukulele", "mandolin", "sitar", "lute"],
    "piano": ["piano", "keyboard", "organ", "harpsichord", "accordion", "celesta"],
    "strings": ["violin", "cello", "viola", "string", "harp", "fiddle", "contrabass"],
    "brass": ["trumpet", "trombone", "tuba", "horn", "brass", "cornet", "flugelhorn"],
    "woodwind": ["saxophone", "flute", "clarinet", "oboe", "bassoon", "wind", "piccolo"],
    "voice": ["voice", "vocal", "choir", "singing", "chant"],
    "synth": ["synth", "electronic", "sampler", "theremin"],
    "other": [],
}
JOB_STAGES = ["analyzing", "trimming", "downloading", "searching", "waiting", "queued"]
# models that report both classes; their series is the first one
FIRST_CLASS_SERIES = ["approachability", "engagement", "voice_instrumental", "gender"]
POSITIVE_CLASS_FIRST = ["mood_happy", "mood_aggressive", "mood_acoustic", "mood_electronic"]

# --- numeric constants ------------------------------------------------------------
NEIGHBOURS = 10
MIN_SERIES_SONGS = 5
LOUDNESS_FLOOR_DB = -70.0
CONSTANT_LEVEL = 0.5
FRAMES_PER_SECOND_VALUE = 43
LOUDNESS_VALUES_PER_SECOND = 10
TARGET_LUFS = -16.0
MIN_TRACK_SECONDS, MAX_TRACK_SECONDS = 45, 600
UNRECOGNISED_LIMIT_SECONDS = 600.0
RECOGNISED_SCORE = 0.5
KNOWN_AUDIO_SCORE = 0.9
LENGTH_TOLERANCE_SECONDS = 15
MAX_LENGTH_FACTOR = 1.25
MIN_CUT_SECONDS = 2.5
CHORUS_SECONDS = 15
CHORUS_MIN_ANALYSABLE_SECONDS = 45
CHORUS_EDGE_SECONDS = 8
CHORUS_EDGE_SHARE = 0.08
CHORUS_REPETITION_WEIGHT = 0.65
CHORUS_ENERGY_WEIGHT = 0.35
CHORUS_SAME_SECTION = 0.92
CHORUS_EPSILON = 1e-8
# feature family -> (hop seconds, window seconds) of its stored series
TIMEBASES = {
    "effnet": (62 * 256 / 16000, 128 * 256 / 16000),
    "musicnn": (93 * 256 / 16000, 187 * 256 / 16000),
    "dsp": (43 * 1024 / 44100, (42 * 1024 + 2048) / 44100),
    "loudness": (10 * 0.1, 3.0 + 9 * 0.1),
}
FEATURE_FAMILY = {
    "loudness": "loudness",
    "spectral_centroid": "dsp", "spectral_rolloff": "dsp", "spectral_flux": "dsp",
    "zero_crossing_rate": "dsp", "dissonance": "dsp",
    "arousal": "musicnn", "valence": "musicnn",
    "approachability": "effnet", "engagement": "effnet", "voice": "effnet", "gender": "effnet",
    "happy": "effnet", "sad": "effnet", "aggressive": "effnet", "party": "effnet",
    "relaxed": "effnet", "acoustic": "effnet", "electronic": "effnet",
}
FIRST_YEAR, LAST_YEAR = 1900, 2030
ALBUM_TYPE_RANK = {"Album": 0, "EP": 1, "Single": 2}
PROVIDER_ALBUM_TYPE_RANK = {"album": 0, "single": 1, "ep": 2, "compilation": 3}
# letters whose folded form has several
FOLDED_LETTERS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
UNDATED = "9999"
ALBUM_WINDOW_YEARS = 1
MIN_SEARCH_SCORE = 70

# --- ranking of search hits -------------------------------------------------------
TITLE_MATCH_WEIGHT = 8.0
TOPIC_BONUS = 3.0
ARTIST_NAMED_BONUS = 3.0
VERIFIED_BONUS = 2.0
VERSION_PENALTY = 4.0
VIEWS_WEIGHT = 0.3
VERSION_WORDS = [
    "live", "cover", "karaoke", "remix", "reaction", "lesson", "tutorial", "transcription",
    "instrumental", "slowed", "sped up", "nightcore", "8d", "loop", "hour", "acoustic",
    "concert", "unplugged", "session", "sessions", "version", "hz",
]
EXTRA_VERSION_WORDS = ["take", "demo"]
EXTRA_RECORDING_WORDS = ["rmx", "mix", "edit", "rework", "bootleg", "vip", "flip"]
QUERY_FILLER_WORDS = ["official", "audio", "video", "music", "lyrics", "lyric", "hd", "hq", "feat", "ft"]
UPLOAD_FILLER_WORDS = [
    "official", "music", "video", "audio", "lyrics", "lyric", "visualizer", "visualiser", "hd", "hq", "4k",
    "mv", "clip", "feat", "ft", "featuring", "with", "remastered", "remaster", "and", "x", "animated",
    "offizielles", "offizieller", "offizielle", "musikvideo",
]

# --- error and failure words ------------------------------------------------------
KNOWN_FAILURE_REASONS = [
    "no_acoustid_match", "needs_metadata", "duplicate", "too_long_unrecognized", "unsupported_format",
    "no_search_hit", "all_hits_in_library", "spotify_mismatch", "no_fitting_hit", "unverified",
]
# kind -> (retryable, scope)
ERROR_KINDS = {
    "unavailable": (False, "video"),
    "geo_blocked": (False, "video"),
    "age_restricted": (False, "video"),
    "rate_limited": (True, "global"),
    "bot_check": (False, "global"),
    "network": (True, "global"),
    "unknown": (False, "unknown"),
}

# --- text patterns ----------------------------------------------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NOISE_BRACKET = (
    r"(?iU)\s*[\(\[]\s*(?:"
    r"official\s*(?:music\s+)?(?:video|audio|lyric(?:s)?\s*video?|lyrics?|visuali[sz]er|clip|"
    r"performance(?:\s+video)?|live(?:\s+video)?|mv)?\b|"
    r"official\s*artist\s*channel|"
    r"music\s*video|video\s*clip|lyric(?:s)?\s*video|lyrics?|audio|visuali[sz]er|"
    r"full\s*hd|hd|hq|4k|2160p|1440p|1080p|720p|480p|360p|"
    r"(?:(?:19|20)\d{2}\s*)?remaster(?:ed)?(?:\s+(?:19|20)\d{2})?|"
    r"auto[\s\-]?generated|ncs\s*(?:release)?|vevo|"
    r"(?:19|20)\d{2}"
    r")[^\)\]]*[\)\]]"
)
NOISE_DASH_TAIL = (
    r"(?iU)\s+-\s+(?:official\s*(?:music\s+)?(?:video|audio|lyrics?|clip|mv)?|"
    r"music\s*video|lyrics?|audio|visuali[sz]er|hd|hq|4k)\s*$"
)
NOISE_PIPE_TAIL = (
    r"(?iU)\s*\|\s*(?:official\s*(?:music\s+)?(?:video|audio|mv)?|"
    r"music\s*video|lyrics?|audio|visuali[sz]er|.+?\s*-\s*topic)\s*$"
)
FEAT_IN_ARTIST = r"(?iU)\s*(?:feat\.?|ft\.?|featuring)\s+.+$"
VERSION_MARKER = (
    r"(?:[^\(\)\[\]]*?[\s\-])?(?:edit|version)|"
    r"(?:single|radio|album|original|extended|short|club)?[\s\-]*mix|"
    r"(?:(?:19|20)\d{2}\s*)?(?:digital(?:ly)?\s*)?remaster(?:ed)?(?:\s+(?:19|20)\d{2})?(?:\s+version)?|"
    r"mono|stereo|live"
)
VERSION_BRACKET = r"(?iU)\s*[\(\[]\s*(?:" + VERSION_MARKER + r")\s*[\)\]]"
VERSION_DASH_TAIL = r"(?iU)\s+-\s+(?:" + VERSION_MARKER + r")\s*$"
TYPOGRAPHIC_QUOTES = ("’‘ʼ“”", "'''\"\"")
SAMPLER_NAME = (
    r"(?iU)\b(?:greatest hits|best of|the very best|collection|classics|anthology|essential|hits|"
    r"klassische musik|classical music|die schönste|most beautiful|playlist|relax)\b"
)
SOUNDTRACK_NAME = r"(?iU)\b(?:soundtrack|ost)\b"
FEATURED_PATTERNS = [
    r"(?iU)\(feat\.?\s+([^)]+)\)",
    r"(?iU)\(ft\.?\s+([^)]+)\)",
    r"(?iU)\(featuring\s+([^)]+)\)",
    r"(?iU)\[feat\.?\s+([^\]]+)\]",
    r"(?iU)\[ft\.?\s+([^\]]+)\]",
    r"(?iU)\[featuring\s+([^\]]+)\]",
    r"(?iU)\bfeat\.?\s+([^(\[,\]]+)",
    r"(?iU)\bft\.?\s+([^(\[,\]]+)",
    r"(?iU)\bfeaturing\s+([^(\[,\]]+)",
]
FEATURED_SPLIT = r"(?iU)\s*[&,]\s*|\s+x\s+|\s+and\s+"
ARTIST_SPLIT = r"(?iU)\s*(?:,|&|\bx\b|\band\b|\bund\b)\s*"
LIBRARY_ARTIST_SPLIT = r"(?iU)\s*(?:,|&|\bfeat\.?|\bft\.?|\bvs\.?|\bx\b)\s*"
FEAT_BRACKET = r"(?iU)\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring|with)\s[^\)\]]*[\)\]]"
FEAT_TAIL = r"(?iU)\s+(?:-\s+)?(?:feat\.?|ft\.?|featuring)\s.+$"
FROM_TAIL = r"(?iU)\s+-\s+from\s.+$"
TRAILING_PART = r"(?U)\s*(?:[\(\[][^\(\)\[\]]*[\)\]]|\s-\s.+)$"
REMASTER = r"(?iU)(?:(?:19|20)\d{2}\s*)?remaster(?:ed)?(?:\s+(?:19|20)\d{2})?(?:\s+version)?"
MATCH_CHANNEL_NOISE = r"(?iU)\s*-\s*topic$|vevo$|\s+official$"
RANK_CHANNEL_NOISE = r"(?iU)\s*-\s*topic$|vevo$|\s+official$|\s+music$|\s+tv$"
CHANNEL_TAIL = r"(?U)(?:\s+(?:official|vevo|topic))+$"
NUMERAL = r"^(?:\d+|i|ii|iii|iv|v|vi|vii|viii|ix|x)$"
YEAR_WORD = r"^(?:19|20)\d{2}$"
TOPIC_SUFFIX = " - topic"
QUERY_SEPARATOR = r"(?U)\s+[-–—]\s+"

VIDEO_SEPARATOR = r"(?U)\s+[-–—|]\s+"
COLON_SEPARATOR = r"(?U):\s+"
# A bracketed part holding one of these words is noise: the same pattern, with the word looked ahead for.
VIDEO_NOISE_WORDS = (
    r"official|video|audio|lyric|visuali[sz]er|\bhd\b|\bhq\b|\b4k\b|\bmv\b|remaster|"
    r"clip|explicit|full song|with lyrics|\blive\b|[\(\[【]\s*from\s|#"
)
FREQUENCY = r"(?iU)\s+\d+\s*hz\b"
HASHTAG = r"(?U)\s+#\w+"
BARE_NOISE_TAIL = r"(?iU)\s+(?:official\s+)?(?:music\s+)?(?:video|audio|lyrics?)(?:\s+video)?\s*$"
QUALITY_TAIL = r"(?iU)(?:\s+(?:hd|hq|4k|1080p|720p))+\s*$"
LIVE_TAIL = r"(?iU)(?:\s+[-–—]\s+live\b.*|(?<=\S)\s+live\s+\S.*)$"
TITLE_FEAT_TAIL = r"(?iU)\s+(?:feat\.?|ft\.?|featuring)\s+.*$"
UPLOADER_NOISE = r"(?iU)(?:\s*-?\s*official)?\s*(?:vevo|music|tv)?\s*$"
QUOTES = "\"'“”‘’«»"
VIDEO_ARTIST_SPLIT = r"(?iU)\s*(?:,|&|\bx\b|\band\b)\s*"
COMPOSER_SEPARATORS = [" - ", " – ", ": "]
AUDIO_SUFFIXES = [".wav", ".mp3", ".flac", ".ogg", ".aiff", ".m4a"]
