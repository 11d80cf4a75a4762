"""Chains of operators: named views, written tables and shared work folders."""
