"""dotloom.functions"""
