"""Time the headline queries and print one JSON line.

Every query is run to completion into the noop sink: all rows and columns are computed, none is collected.
``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tunefathom.queries import load
from tunefathom.session import build_session

HEADLINE = [
    "a15_correlations", "m8_knn", "m9_project_2d", "a16_envelope_relative", "a16_envelope_absolute", "w6_chorus_segment",
    "a2_library_totals", "a3_histogram", "a10_detailed_genre_counts", "a12_label_rows", "w1_top_n_labels", "f4_label_filter",
    "a18_seconds_from_frames", "a21_chord_stats", "a24_parent_genre_shares", "w5_music_span", "w7_queue_moves", "w10_stage_since",
    "t4_clean_title", "t16_strip_html", "j5_resolve_tracks", "j6_in_library", "j8_candidate_fits", "o3_rank_hits",
    "e2_pick_recording", "e9_pick_album", "a26_import_end", "j15_backfill_finished", "e14_start_import", "x2_stream_job_stage",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    # start the JVM's code paths and the Python workers before the clock runs
    for name in ("a2_library_totals", "t1_song_id"):
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
