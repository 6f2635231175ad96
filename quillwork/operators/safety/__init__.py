"""Scanning, redaction, sanitizing, output filtering and conversation checks."""
