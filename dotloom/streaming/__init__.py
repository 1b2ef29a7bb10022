"""dotloom.streaming"""
