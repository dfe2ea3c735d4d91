"""Readers and writers: typed tables, raw asset manifests, workbooks, cached endpoint pages, documents."""
