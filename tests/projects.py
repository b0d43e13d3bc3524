"""Two small projects written for these tests: a Django-shaped one and a Next.js-shaped one."""

DJANGO = {
    "common/__init__.py": "",
    "common/mixins.py": '''"""Model mixins."""
from django.db import models
from django.utils import timezone


class TimestampMixin(models.Model):
    """Keeps created and updated times."""

    created_at = models.DateTimeField(auto_now_add=True)

    def touch(self):
        self.save()


class SoftDeleteMixin(models.Model):
    """Soft deletion: rows are flagged, not removed."""

    def soft_delete(self):
        """Flag the row as deleted."""
        self.deleted_at = timezone.now()
''',
    "common/utils.py": '''"""Shared helpers."""
import hmac


def constant_time_equals(left, right):
    """Compare two secrets such as passwords safely."""
    return hmac.compare_digest(left, right)


def mask_email(email):
    """Mask an email address before it is logged."""
    head, _, tail = email.partition("@")
    return head[:1] + "***@" + tail


def audit_event(name, **fields):
    print(name, fields)


def chunked(items, size):
    """Split a list into batches of a size."""
    for i in range(0, len(items), size):
        yield items[i:i + size]
''',
    "authx/__init__.py": "",
    "authx/models.py": '''from django.db import models

from common.mixins import TimestampMixin


class User(TimestampMixin):
    email = models.EmailField()

    def display_name(self):
        """Choose the display name of a user."""
        return self.email


class ApiToken(TimestampMixin):
    user = models.ForeignKey(User, on_delete=models.CASCADE)

    def revoke(self):
        self.delete()
''',
    "authx/serializers.py": '''from rest_framework import serializers

from .models import ApiToken


class LoginSerializer(serializers.Serializer):
    def validate(self, attrs):
        return attrs


class ApiTokenSerializer(serializers.ModelSerializer):
    class Meta:
        model = ApiToken
''',
    "authx/services.py": '''"""Token services."""
import sys

from common.utils import audit_event, constant_time_equals

from .models import ApiToken, User

API_SECRET = "s3cr3t-value-123"


def verify_credentials(email, password):
    """Check an email and a password at login."""
    user = User.objects.get(email=email)
    return constant_time_equals(user.password, password)


def issue_token(user, *, length=32):
    """Issue an API token for a user."""
    token = ApiToken(user=user)
    audit_event("issued")
    return token


def revoke_all(user):
    """Revoke all tokens of a user at once."""
    for token in ApiToken.objects.filter(user=user):
        token.revoke()


if sys.platform == "win32":
    def clock_skew_seconds(now):
        return 2
else:
    def clock_skew_seconds(now):
        return 0
''',
    "authx/views.py": '''from rest_framework.views import APIView

from common.utils import audit_event, mask_email

from .models import ApiToken
from .serializers import LoginSerializer
from .services import issue_token, verify_credentials


class LoginView(APIView):
    serializer_class = LoginSerializer

    def post(self, request):
        form = LoginSerializer(data=request.data)
        user = verify_credentials(form["email"], form["password"])
        audit_event(mask_email(form["email"]))
        return issue_token(user)


class TokenRevokeView(APIView):
    def delete(self, request):
        token = ApiToken.objects.get(pk=1)
        audit_event("revoked")
        token.revoke()
''',
    "authx/urls.py": '''from django.urls import include, path

from .views import LoginView, TokenRevokeView

urlpatterns = [
    path("login/", LoginView.as_view()),
    path("revoke/", TokenRevokeView.as_view()),
    path("more/", include("authx.more")),
]
''',
    "billing/__init__.py": "",
    "billing/models.py": '''from authx.models import User
from common.mixins import SoftDeleteMixin, TimestampMixin
from django.db import models


class Subscription(TimestampMixin, SoftDeleteMixin):
    user = models.ForeignKey(User, on_delete=models.CASCADE)

    def monthly_total(self):
        """Compute the total of a subscription."""
        return 1

    def cancel(self):
        self.soft_delete()
''',
    "billing/tasks.py": '''from common.utils import audit_event, chunked

from .models import Subscription


def charge_card(user, amount, *, key=None):
    """Charge a customer card."""
    audit_event("charge")


def run_monthly_billing(size=10):
    """Run the monthly billing."""
    for batch in chunked(Subscription.objects.all(), size):
        charge_card(batch, 1)


def retry_failed(user):
    charge_card(user, 2)
''',
    "billing/views.py": '''from rest_framework.views import APIView

from common.utils import audit_event

from .tasks import charge_card


class SubscriptionView(APIView):
    def post(self, request):
        charge_card(request.user, 5)
        audit_event("subscribed")
''',
    "broken.py": "def half(:\n    pass\n",
}

NEXT = {
    "app/api/users/route.ts": '''import { NextResponse } from 'next/server';
import { getUserById } from '@/lib/users';

/**
 * Reads one user.
 */
export async function GET(request: Request): Promise<Response> {
  const user = await getUserById('1');
  return NextResponse.json(user ?? {}, { status: 200 });
}

export function parse(x: string): string;
export function parse(x: number): string;
export function parse(x: any): string {
  return String(x);
}

function join(...parts: string[]): string {
  return parts.map((p) => { return trim(p); }).join('/');
}

const withDefault = (limit: number = 20, cursor?: string) => ({ limit, cursor });
''',
    "app/api/orders/route.ts": '''export async function GET(request: Request) {
  return null;
}
''',
    "lib/users.ts": '''export async function getUserById(id: string) {
  return { id };
}
''',
    "components/Card.tsx": ''''use client';
import React, { useState } from 'react';
import { Base } from './Base';

export default function Card({ id }: { id: string }) {
  const [name, setName] = useState<string>('');
  const go = React.useCallback(() => setName(id), [id]);
  return <div onClick={go}>{name}</div>;
}

export class CardError extends Base {
  constructor(message: string) {
    super(message);
  }

  describe(): string {
    return this.render() + this.label();
  }

  label() {
    return 'x';
  }
}
''',
    "components/Base.tsx": '''export class Base {
  constructor(public message: string) {}

  render() {
    return this.message;
  }
}
''',
}


def as_files(spark, extra=None):
    rows = [("dj", p, bytearray(t.encode())) for p, t in DJANGO.items()]
    rows += [("nx", p, bytearray(t.encode())) for p, t in NEXT.items()]
    rows += [(r, p, bytearray(t.encode())) for r, p, t in (extra or [])]
    return spark.createDataFrame(rows, "repo_id string, rel_path string, content binary").repartition(4)
