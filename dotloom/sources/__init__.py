"""dotloom.sources"""
