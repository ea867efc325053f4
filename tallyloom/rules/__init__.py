"""Packaged rule tables; every operator accepts a replacement."""
