"""Readers for the declared tables and for the JSON inputs."""
