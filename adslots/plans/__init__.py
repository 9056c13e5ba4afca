"""Whole jobs made of operators, each over a catalogue at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import candidates as c
from ..operators import slots as s
from ..operators import speakers as k
from ..operators import transcript as t


def analyse_slots(episodes: DataFrame, silences: DataFrame, segments: DataFrame) -> DataFrame:
    """The best three separated slots of every track, from its silences (as candidates) and its transcript."""
    merged = c.collapse_near(silences, c.boundary_candidates(segments, episodes))
    scored = c.score(c.fill_empty(episodes, merged), episodes)
    return s.pros_cons(s.slot_record(c.clamp_dedupe(c.top_up(c.select_separated(scored)))))


def place_ads(lengths: DataFrame, cands: DataFrame, responses: DataFrame, products: DataFrame) -> DataFrame:
    """The place of one ad for every track: bounded candidates, a default, and the model's choice if it fits."""
    bounded = c.bound(cands, lengths)
    return c.apply_choice(c.default_insertion(lengths, bounded), bounded, t.parse_choice(responses, products), lengths)


def write_scripts(responses: DataFrame, products: DataFrame) -> DataFrame:
    """The lines to be spoken for every product, in its mode."""
    return k.lines_for_mode(k.script_lines(responses, products), products)
