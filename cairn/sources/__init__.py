"""Readers, gates and sampling."""
