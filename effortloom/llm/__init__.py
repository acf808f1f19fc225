"""Operators for preparing large text corpora. Nothing outside this folder imports them.

Every operator takes a DataFrame and the names of its id and text columns, reads no other column of it, and returns a
new frame; columns of the input with clashing names are therefore never in the way.
"""
