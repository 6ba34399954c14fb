"""Readers that give raw listings, and writers."""
