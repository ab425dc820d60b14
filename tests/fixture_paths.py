"""Folders of the tables that tests read."""

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"
