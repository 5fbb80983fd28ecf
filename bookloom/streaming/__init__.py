"""Structured streams of order events."""
