import hypothesis

hypothesis.settings.register_profile("quick", max_examples=25, deadline=None)
hypothesis.settings.load_profile("quick")
