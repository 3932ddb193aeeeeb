"""Declared schemas; no reader infers one."""

from __future__ import annotations

SONGS = ("song_id string, title string, artist string, recording_id string, metadata_source string, "
         "reviewed boolean, original_name string, video_id string")
DSP = ("song_id string, bpm double, beat_confidence double, danceability double, onset_rate double, key string, scale string, "
       "key_strength double, chord_strength_mean double, chord_change_rate double, integrated_lufs double, "
       "loudness_range_lu double, dynamic_complexity double, loudness_db double, spectral_centroid_mean double, "
       "spectral_rolloff_mean double, spectral_flux_mean double, zero_crossing_rate double, dissonance double, "
       "mfcc_mean array<double>, loudness_short_term_timeseries array<double>, spectral_centroid_timeseries array<double>, "
       "spectral_rolloff_timeseries array<double>, spectral_flux_timeseries array<double>, "
       "zero_crossing_rate_timeseries array<double>, dissonance_timeseries array<double>")
PROFILE = ("song_id string, niche_score double, mainstream_score double, background_score double, active_score double, "
           "instrumental_score double, vocal_score double, female_score double, male_score double, arousal double, valence double, "
           "approachability_timeseries array<double>, engagement_timeseries array<double>, voice_timeseries array<double>, "
           "gender_timeseries array<double>, arousal_timeseries array<double>, valence_timeseries array<double>")
MOODS = "song_id string, " + ", ".join(f"{m} double" for m in ("happy", "sad", "aggressive", "party", "relaxed", "acoustic", "electronic")) + ", " + ", ".join(
    f"{m}_timeseries array<double>" for m in ("happy", "sad", "aggressive", "party", "relaxed", "acoustic", "electronic"))
OTHER = ("song_id string, gmbi_valence double, gmbi_arousal double, gmbi_authenticity double, gmbi_timeliness double, "
         "gmbi_complexity double, tonal double, tonal_timeseries array<double>, hpcp_mean array<double>, tristimulus_mean array<double>")
FILES = "song_id string, filename string, file_format string, duration_seconds double, sample_rate_hz int, channels int, bitrate_kbps int"
TRACKS = ("song_id string, album string, album_id string, release_date string, playcount bigint, listeners bigint, "
          "genres array<string>, featured_artists array<string>, similar_tracks array<struct<title: string, artist: string, similarity: double>>")
ARTISTS = "artist string, artist_playcount bigint, artist_listeners bigint, bio string, similar_artists array<string>"
LABELS = "song_id string, label string, score double"

ONE_TO_ONE = {"dsp": DSP, "profile": PROFILE, "moods": MOODS, "other": OTHER, "files": FILES, "tracks": TRACKS}
LABEL_TABLES = ("parent_genres", "detailed_genres", "instruments")

IMPORTS = "import_id bigint, user_id bigint, playlist_id string, name string, created_at timestamp"
IMPORT_TRACKS = ("id bigint, import_id bigint, position int, track_id string, title string, artists_json string, duration_ms bigint, "
                 "isrc string, status string, reason string, song_id string, video_id string, finished_at timestamp")
PLAYLISTS = ("playlist_id string, user_id bigint, kind string, name string, version string, collaborative boolean, artists string, "
             "tracks array<struct<id: string, title: string, artists: array<string>, album_id: string, album_name: string, album_artists: array<string>>>")
PLAYLIST_SONGS = "playlist_id string, song_id string, position int"
FAILURES = ("id bigint, source string, label string, video_id string, status string, reason string, detail string, "
            "title string, artist string, song_id string, created_at timestamp")

# Landed catalogue documents
_ARTIST = "struct<name: string, `sort-name`: string>"
_CREDIT = f"array<struct<name: string, artist: {_ARTIST}>>"
RELEASE = (f"struct<title: string, status: string, date: string, `artist-credit`: {_CREDIT}, "
           "`release-group`: struct<id: string, title: string, `primary-type`: string, `secondary-types`: array<string>>>")
RECORDING_SEARCH = ("query_id string, count bigint, recordings array<struct<id: string, title: string, score: int, "
                    f"`artist-credit`: {_CREDIT}, releases: array<{RELEASE}>>>")
_TRACK = ("struct<id: string, name: string, type: string, is_local: boolean, duration_ms: bigint, external_ids: struct<isrc: string>, "
          "artists: array<struct<name: string>>, album: struct<id: string, name: string, artists: array<struct<name: string>>>>")
PLAYLIST_PAGE = f"playlist_id string, page int, items array<struct<item: {_TRACK}, track: {_TRACK}>>"
SIMILAR_TRACKS = "array<struct<name: string, match: string, artist: string>>"
ANALYSIS_RESULT = ("title string, artist string, recording_id string, metadata_source string, original_name string, video_id string, "
                   f"dsp struct<{DSP.split(', ', 1)[1]}>, profile struct<{PROFILE.split(', ', 1)[1]}>, moods struct<{MOODS.split(', ', 1)[1]}>, "
                   f"other struct<{OTHER.split(', ', 1)[1]}>, files struct<{FILES.split(', ', 1)[1]}>, tracks struct<{TRACKS.split(', ', 1)[1]}>, "
                   f"artist_info struct<{ARTISTS.split(', ', 1)[1]}>, "
                   "parent_genres array<struct<label: string, score: double>>, detailed_genres array<struct<label: string, score: double>>, "
                   "instruments array<struct<label: string, score: double>>")
