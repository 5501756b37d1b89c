"""Readers and writers of task records, prompts, responses and configuration."""
