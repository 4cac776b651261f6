"""Fixed values of the internal tables.

Names in loaders are resolved from headers (sources.tables). ``show_id, cut_id`` lead every key.
Frame counts are bigint: 1-based and end-inclusive.
"""

#: Frames grabbed of a shot, in order.
POSITIONS = ("start", "mid", "end")
