"""Operators on frames, candidates, slots, transcripts, speakers, sponsors, splices and products."""
