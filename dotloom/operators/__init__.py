"""dotloom.operators"""
