"""Operators over tables of raw strings: profiling, typing, matching, validation, identity, merging, reports."""
