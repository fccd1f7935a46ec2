"""Readers and writers for the canonical tables and their raw inputs."""
