"""dotloom.plans"""
